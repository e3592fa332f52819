"""Prompts of zero-shot classes and tags."""

# What stored scores were made with.
CLASS_PROMPTS = {
    "rhythmic": ("a drum hit", "a single drum sound", "a percussion hit", "a percussive sound effect", "a drum loop", "a percussion loop", "a foley hit", "a rhythmic beat", "a hi-hat", "a cymbal", "a kick drum", "a snare drum"),
    "melodic": ("a musical note played on an instrument", "a synthesizer sound", "a melodic loop", "a chord played on an instrument", "a bass note", "a piano note", "a guitar note", "a melody", "a synth lead", "a synth pad chord", "a plucked string note", "a keyboard melody"),
    "vocal": ("a human voice", "a person singing", "a person speaking", "a vocal phrase", "a vocal shout", "a vocal sample", "a woman speaking", "a man speaking", "spoken words", "a sung vocal line", "a vocal breath", "a voice saying a word"),
    "other": ("an ambient texture", "a drone", "a riser sound effect", "an impact sound effect", "a whoosh sound effect", "background ambience", "white noise", "a cinematic sound design texture", "an atmospheric pad texture", "a sci-fi ambience", "wind", "a sustained noise texture"),
}
TAGS = ("kick drum", "snare drum", "hi-hat", "hand clap", "tom drum", "cymbal", "shaker", "percussion", "808 bass", "bass", "synth lead", "synth pad", "pluck", "piano", "guitar", "strings", "brass", "bell", "vocal", "spoken word", "vocal chop", "drum loop", "melodic loop", "riser", "impact", "whoosh", "glitch", "noise", "texture", "drone", "ambience", "foley")
TAG_PROMPT = "the sound of {}"
