"""Queries over files that they write first, over layouts that are kept, and over runs."""

from __future__ import annotations

import hashlib
import struct
import threading

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield import working
from nearfield.functions import encoders, prompts, signal
from nearfield.io import Tables
from nearfield.operators import intervals, state, vectors
from nearfield.plans import jobs
from nearfield.plans._registry import query
from nearfield.plans.models import _tones
from nearfield.sources import folders, ingest, layouts
from nearfield.streaming import incremental, serving


def _values(rows: list[tuple], names: str) -> str:
    shown = lambda v: "NULL" if v is None else str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(shown, r)) + ')' for r in rows)}) v({names})"


def _written(t: Tables) -> str:
    """A folder with a file for each supplier, some below names with a leading dot or underscore."""
    root = working.fresh(t.spark, "library")

    def write(batches):
        for b in batches:
            for k in b["s_suppkey"]:
                system, inside = ingest.opened(root)
                folder = f"{inside}/{('_packs', '.kits', 'drums/loops', '.')[k % 4]}"
                system.create_dir(folder, recursive=True)
                with system.open_output_stream(f"{folder}/{'._' if k % 7 == 0 else ''}{k}.wav") as f:
                    f.write(b"x" * (10 + k % 50))
            yield b

    tasks = int(t.spark.conf.get("spark.sql.shuffle.partitions"))
    t.supplier.select("s_suppkey").repartition(tasks).mapInPandas(write, "s_suppkey long").count()
    return root


def _digest(content: bytes) -> str:
    return hashlib.blake2b(content).hexdigest()


#: BLAKE2b of the fifty contents that _written() makes.
_DIGESTS = "CASE s_suppkey % 50 " + " ".join(f"WHEN {n} THEN '{_digest(b'x' * (10 + n))}'" for n in range(50)) + " END"


@query("walked_files", "A1 A3 A6", f"SELECT CASE s_suppkey % 4 WHEN 0 THEN '_packs' WHEN 1 THEN '.kits' WHEN 2 THEN 'drums/loops' ELSE '' END AS folder, CASE WHEN s_suppkey % 7 = 0 THEN '._' ELSE '' END || CAST(s_suppkey AS VARCHAR) || '.wav' AS filename, CAST(10 + s_suppkey % 50 AS BIGINT) AS file_size, {_DIGESTS} AS hash FROM supplier")
def walked_files(t: Tables) -> DataFrame:
    """Every file below a folder, whatever its name, hashed where it lies."""
    files = ingest.listing(t.spark, _written(t))
    return files.join(ingest.hashed(files).where("error is null"), "path").select("folder", "filename", "file_size", "hash")


@query("folder_source", "A1 A3", "SELECT CASE s_suppkey % 4 WHEN 0 THEN '_packs' WHEN 1 THEN '.kits' WHEN 2 THEN 'drums/loops' ELSE '' END AS folder, CAST(s_suppkey AS VARCHAR) || '.wav' AS filename, CAST(10 + s_suppkey % 50 AS BIGINT) AS file_size FROM supplier WHERE s_suppkey % 7 <> 0 AND s_suppkey % 4 IN (0, 2)")
def folder_source(t: Tables) -> DataFrame:
    """The same files read as a source; the condition on folders is met while they are listed."""
    files = folders.registered(t.spark).read.format(folders.FORMAT).option("tasks", t.spark.conf.get("spark.sql.shuffle.partitions")).load(_written(t))
    return files.where(F.col("folder").isin("_packs", "drums/loops") & (F.col("ext") == ".wav") & ~F.col("filename").startswith("._")).select("folder", "filename", "file_size")


def _changed(t: Tables, root: str) -> None:
    """Of each six suppliers' files: one is written anew, one moved, one removed, one written again as it was, and two stay; each ninth gets a new neighbour."""

    def work(batches):
        system, inside = ingest.opened(root)
        for b in batches:
            for k in b["s_suppkey"]:
                path = f"{inside}/{k % 3}/{k}.wav"
                if k % 6 == 1:
                    system.move(path, f"{inside}/moved/{k}.wav")
                elif k % 6 == 2:
                    system.delete_file(path)
                elif k % 6 in (3, 4):
                    with system.open_output_stream(path) as f:
                        f.write(b"other %d" % k if k % 6 == 3 else b"file %d" % k)
                if k % 9 == 0:
                    with system.open_output_stream(f"{inside}/{k % 3}/new{k}.wav") as f:
                        f.write(b"new %d" % k)
            yield b

    _per_supplier(t, work)


def _per_supplier(t: Tables, work) -> None:
    tasks = int(t.spark.conf.get("spark.sql.shuffle.partitions"))
    t.supplier.select("s_suppkey").repartition(tasks).mapInPandas(work, "s_suppkey long").count()


@query(
    "rescanned_files",
    "A2 L1 C13 C14 G2",
    """WITH s AS (SELECT s_suppkey AS k, CAST(s_suppkey % 3 AS VARCHAR) || '/' || CAST(s_suppkey AS VARCHAR) || '.wav' AS path FROM supplier),
was AS (SELECT k, row_number() OVER (ORDER BY path) AS id, path FROM s),
new AS (SELECT CAST(k % 3 AS VARCHAR) || '/new' || CAST(k AS VARCHAR) || '.wav' AS path FROM s WHERE k % 9 = 0)
SELECT CASE WHEN k % 6 = 1 THEN 'moved/' || CAST(k AS VARCHAR) || '.wav' ELSE path END AS path, id, CASE k % 6 WHEN 1 THEN 'moved' WHEN 2 THEN 'removed' WHEN 3 THEN 'changed' WHEN 4 THEN 'same' ELSE 'same' END AS change, CASE WHEN k % 6 = 1 THEN path END AS old_path FROM was
UNION ALL SELECT path, (SELECT count(*) FROM supplier) + row_number() OVER (ORDER BY path), 'added', NULL FROM new""",
)
def rescanned_files(t: Tables) -> DataFrame:
    """A folder with a file for each supplier is scanned, changed, and scanned again: what the second run found."""
    root = working.fresh(t.spark, "rescan")

    def write(batches):
        system, inside = ingest.opened(root)
        for b in batches:
            for k in b["s_suppkey"]:
                for folder in (f"{inside}/{k % 3}", f"{inside}/moved"):
                    system.create_dir(folder, recursive=True)
                with system.open_output_stream(f"{inside}/{k % 3}/{k}.wav") as f:
                    f.write(b"file %d" % k)
            yield b

    _per_supplier(t, write)
    nothing = t.spark.createDataFrame([], "id long, path string, size long, mtime timestamp, hash string")
    _, known = ingest.rescanned(t.spark, root, nothing)
    _changed(t, root)
    changes, _ = ingest.rescanned(t.spark, root, known)
    below = lambda c: F.regexp_extract(c, "/rescan-[0-9a-f]+/(.*)$", 1)
    # a file written again as it was is unchanged if its time is still the same, else identical
    same = F.when(F.col("change").isin("unchanged", "identical"), "same").otherwise(F.col("change"))
    return changes.select(below("path").alias("path"), "id", same.alias("change"), F.when(F.col("old_path").isNotNull(), below("old_path")).alias("old_path"))


_PITCH = "CAST(220 + 10 * (s_suppkey % 20) AS BIGINT)"


def _tens(hz) -> int | None:
    return None if hz is None else int(round(hz, -1))


@query("described_windows", "E13 E12", f"SELECT '/tones/' || CAST(s_suppkey AS VARCHAR) || '.wav' AS path, {_PITCH} AS f0, TRUE AS shorter FROM supplier")
def described_windows(t: Tables) -> DataFrame:
    """The middle half second of each tone, with frames around it."""

    def run(batches):
        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                y = signal.decoded(content)
                d = signal.described_window(y, 250, 750)
                yield pd.DataFrame([(path, _tens(d["f0_hz"]), len(signal.frame_features(y[:11025]).mel) < len(signal.frames(y, signal.FRAME, signal.HOP)))], columns=["path", "f0", "shorter"])

    return _tones(t.supplier).mapInPandas(run, "path string, f0 long, shorter boolean")


@query("detection_envelopes", "I4 I8", "SELECT '/tones/' || CAST(s_suppkey AS VARCHAR) || '.wav' AS path, profile, CAST(48 AS BIGINT) AS frames, TRUE AS at_start FROM supplier, (SELECT unnest(['tight', 'loose']) AS profile)")
def detection_envelopes(t: Tables) -> DataFrame:
    """Both profiles of each tone; a tone that begins at once is found at its beginning."""

    def run(batches):
        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                y, rows = signal.decoded(content), []
                for profile in ("tight", "loose"):
                    onset, _ = signal.envelopes(y, profile)
                    rows.append((path, profile, len(onset), int(np.argmax(onset)) <= signal.LEAD_IN + 2))
                yield pd.DataFrame(rows, columns=["path", "profile", "frames", "at_start"])

    return _tones(t.supplier).mapInPandas(run, "path string, profile string, frames long, at_start boolean")


@query("pending_described", "K11 K1 A4 H26", f"SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 1 AND s_suppkey % 10 <> 3 THEN {_PITCH} ELSE -1 END AS f0, CASE WHEN s_suppkey % 2 = 1 AND s_suppkey % 10 <> 3 THEN 2 ELSE 1 END AS version FROM supplier")
def pending_described(t: Tables) -> DataFrame:
    """A run: what is stale is described, written and stamped; a file that can't be read stays due."""
    stored = t.supplier.select(F.col("s_suppkey").alias("id"), F.lit(-1).cast("long").alias("f0"), F.lit(1).alias("version"))
    key = F.regexp_extract("path", "([0-9]+)", 1).cast("long")

    def do(work: DataFrame) -> DataFrame:
        files = _tones(work.select(F.col("id").alias("s_suppkey"))).withColumn("content", F.when(key % 10 == 3, F.lit(b"broken")).otherwise(F.col("content")))
        d = signal.described_files(files)
        return d.select(key.alias("id"), F.round("d.f0_hz", -1).cast("long").alias("f0"), F.lit(2).alias("version"), "error")

    return jobs.run_stage(stored.where("id % 2 = 1"), do, stored, "id")[0]


_SAMPLES = "SELECT '/tones/' || CAST(s_suppkey AS VARCHAR) || '.wav' AS path, CAST(2 AS BIGINT) AS windows, CAST(1 AS BIGINT) AS short, CAST(4 AS BIGINT) AS classes, CAST(32 AS BIGINT) AS tags, TRUE AS unit FROM supplier"


@query("embedded_samples", "J1 J2 J5 J6 D16", _SAMPLES)
def embedded_samples(t: Tables) -> DataFrame:
    """Each tone's windows embedded, one too short counted and left out, their mean as the file's vector, scored by the prompts of classes and tags."""

    def run(batches):
        encoder = encoders.HashingEncoder()
        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                y = signal.decoded(content)
                parts = [y[:11025], y[11025:], y[:1000]]
                long = [p for p in parts if len(p) >= 0.2 * signal.RATE]
                vectors_ = encoder.signals(long)
                yield pd.DataFrame([(path, len(parts) - len(long), v.tolist()) for v in vectors_], columns=["path", "short", "vector"])

    parts = working.stored(_tones(t.supplier).mapInPandas(run, "path string, short long, vector array<double>"))
    mean = vectors.mean_pooled(parts, "path", "vector").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("v"), F.round(F.sum(F.col("value") * F.col("value")), 6).alias("length"))
    mean = mean.select("path", F.transform("v", lambda e: e["value"]).alias("vector"), (F.col("length") == 1).alias("unit"))
    encoder = encoders.HashingEncoder()
    named = [("class " + c, p) for c, own in prompts.CLASS_PROMPTS.items() for p in own] + [("tag " + g, prompts.TAG_PROMPT.format(g)) for g in prompts.TAGS]
    texts = encoder.texts([p for _, p in named]).tolist()
    asked = t.spark.createDataFrame([(c, v) for (c, _), v in zip(named, texts, strict=True)], "class string, vector array<double>")
    scores = vectors.class_scores(mean, asked, "path", "vector")
    found = scores.groupBy("path").agg(F.count_if(F.col("class").startswith("class ")).alias("classes"), F.count_if(F.col("class").startswith("tag ")).alias("tags"))
    sizes = parts.groupBy("path").agg(F.count("*").alias("windows"), F.max("short").alias("short"))
    return sizes.join(found, "path").join(mean.select("path", "unit"), "path").select("path", "windows", "short", "classes", "tags", "unit")


_PROMPTS = [(c, p) for c, own in prompts.CLASS_PROMPTS.items() for p in own] + [("tag", prompts.TAG_PROMPT.format(g)) for g in prompts.TAGS]


@query("prompts", "J3", _values(_PROMPTS, "kind, prompt"), fixed=True)
def all_prompts(t: Tables) -> DataFrame:
    return t.spark.createDataFrame(_PROMPTS, "kind string, prompt string")


@query("captions", "J7", "SELECT p_partkey, CASE WHEN p_partkey % 10 > 0 THEN 'sound of ' || p_name END AS caption, CASE WHEN p_partkey % 10 = 0 THEN 'no caption' END AS error FROM part")
def captions(t: Tables) -> DataFrame:
    def model():
        def caption(text: str) -> str:
            if not text:
                raise ValueError("no caption")
            return "sound of " + text

        return caption

    rows = t.part.select("p_partkey", F.when(F.col("p_partkey") % 10 > 0, F.col("p_name")).otherwise("").alias("content"))
    return encoders.captioned(rows, model, "p_partkey", "content")


@query("kept_layout", "A20 J8 J10", "SELECT vec_id AS id, TRUE AS same FROM embeddings")
def kept_layout(t: Tables) -> DataFrame:
    """A plane fitted and saved, and the parent of one segment placed anew by what was saved: it stands where it stood."""
    folder = working.fresh(t.spark, "layouts")
    items = t.embeddings.select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x, i: x.cast("double") * F.when(i < 32, 1.0).otherwise(0.5)).alias("vector"))
    first = working.stored(layouts.fitted(items, folder, 7, {"a": 1.0, "b": 0.25}))
    segments = t.embeddings.select((F.col("vec_id") + 1_000_000).alias("id"), F.col("vec_id").alias("parent"))
    away = first.withColumn("x", F.when(F.col("id") == 5, 1e9).otherwise(F.col("x")))
    again = layouts.place(away, items, segments, folder, 7, "segment", 1_000_005)
    return again.join(first.select("id", F.col("x").alias("x0"), F.col("y").alias("y0")), "id").select("id", ((F.abs(F.col("x") - F.col("x0")) < 1e-9) & (F.abs(F.col("y") - F.col("y0")) < 1e-9)).alias("same"))


_REPORTS = [("all", "3 done", 2), ("broken", "1 done; second failed: no model", 1), ("nothing", "nothing to do", 0), ("no scope", "the scope is empty", 0)]


@query("run_reports", "H26 M12 K12", _values(_REPORTS, "run, report, steps"), fixed=True)
def run_reports(t: Tables) -> DataFrame:
    """Plans that end well, that break off at a step, that have none, and that have an empty scope."""
    ran: list[str] = []

    def step(name: str, n: int):
        return lambda: ran.append(name) or jobs.Report({"done": n})

    def broken():
        raise RuntimeError("no model")

    rows = []
    for name, steps, scope in (("all", [("first", step("first", 1)), ("second", step("second", 2))], None), ("broken", [("first", step("first", 1)), ("second", broken), ("third", step("third", 1))], None), ("nothing", [], None), ("no scope", [("first", step("first", 1))], [])):
        ran.clear()
        try:
            text = jobs.run_plan(steps, scope=scope).text()
        except ValueError as e:
            text = str(e)
        rows.append((name, text, len(ran)))
    return t.spark.createDataFrame(rows, "run string, report string, steps int")


_RULES = [("sensitivity", True), ("most", True), ("min_length", True), ("profile", True), ("min_unit", True), ("boundary", True), ("none", False)]


@query("settings_rules", "H27", _values(_RULES, "setting, refused"), fixed=True)
def settings_rules(t: Tables) -> DataFrame:
    bad = {"sensitivity": 2, "most": 0, "min_length": 3.0, "profile": "x", "min_unit": "m", "boundary": "x"}
    rows = []
    for name, _ in _RULES:
        try:
            intervals.Segmentation(**({name: bad[name]} if name in bad else {}))
            rows.append((name, False))
        except ValueError:
            rows.append((name, True))
    return t.spark.createDataFrame(rows, "setting string, refused boolean")


_SERVED = [("batch in order", "first,second"), ("stale result", "dropped"), ("fresh result", "3"), ("superseded query", "dropped"), ("newest query", "2")]


@query("served_queries", "L3 L4 L5", _values(_SERVED, '"case", result'), fixed=True)
def served_queries(t: Tables) -> DataFrame:
    """Batches one at a time, a result of an older index, and a query that a newer one supersedes."""
    rows = [("batch in order", ",".join(serving.OneWriter().run([lambda: "first", lambda: "second"])))]
    kept = serving.Versioned()
    stale = kept.get("x", lambda: kept.changed() or t.spark.range(1))
    rows.append(("stale result", "dropped" if stale is None else "kept"))
    with serving.pool(t.spark, "interactive"):
        fresh = kept.get("x", lambda: t.spark.range(3))
        rows.append(("fresh result", str(fresh.count())))
    kept.changed()
    newest = serving.NewestWins(t.spark)
    started, go = threading.Event(), threading.Event()

    def slow() -> int:
        started.set()
        go.wait(60)
        return 1

    first = newest.submit(slow)
    started.wait(60)
    second = newest.submit(lambda: t.spark.range(2).count())
    go.set()
    rows += [("superseded query", "dropped" if first.result(120) is None else "kept"), ("newest query", str(second.result(120)))]
    return t.spark.createDataFrame(rows, "`case` string, result string")


@query("correction_targets", "M7", "SELECT c_custkey AS id, c_custkey % 3 <> 0 AS corrected FROM customer")
def correction_targets(t: Tables) -> DataFrame:
    """A correction of the current item or of a selection, over all rows: groups of three, of which the first two are selected or the first is current."""
    two, one = state.targets(1, [1, 2], True), state.targets(1, [1, 2], False)
    chosen = F.array(*map(F.lit, sorted({*two, *one})))
    return t.customer.select(F.col("c_custkey").alias("id"), F.array_contains(chosen, (F.col("c_custkey") % 3).cast("int")).alias("corrected"))


_READ = """SELECT '/f/' || CAST(s_suppkey AS VARCHAR) AS path, CASE k WHEN 2 THEN NULL ELSE 0.1::DOUBLE END AS seconds, CASE k WHEN 1 THEN 44100 WHEN 2 THEN NULL ELSE 22050 END AS rate, CASE k WHEN 1 THEN 2 WHEN 2 THEN NULL ELSE 1 END AS channels,
CASE k WHEN 0 THEN 100 + s_suppkey % 50 END AS tempo, CASE k WHEN 0 THEN 60 + s_suppkey % 12 END AS note, CASE k WHEN 2 THEN NULL ELSE 2205 END AS samples FROM (SELECT *, s_suppkey % 4 AS k FROM supplier)"""


def _file(k: int) -> bytes:
    """By key: a file with loop and sampler chunks, a stereo one at twice the rate, a broken one, one of floats."""
    y = 0.5 * np.sin(np.arange(2205) / 7)
    if k % 4 == 0:
        acid = struct.pack("<IHHfIHHf", signal.ROOT_SET, k % 12, 0, 0.0, 8, 4, 4, 100 + k % 50)
        return signal.wave_bytes(y, 22050, {b"acid": acid, b"smpl": struct.pack("<9I", 0, 0, 0, 60 + k % 12, 0, 0, 0, 0, 0)})
    if k % 4 == 1:
        return signal.wave_bytes(np.stack([np.repeat(y, 2)] * 2, axis=1), 44100)
    if k % 4 == 2:
        return b"broken"
    fmt = struct.pack("<HHIIHH", 0xFFFE, 1, 22050, 88200, 4, 32) + struct.pack("<HHIH", 22, 32, 4, 3) + bytes(14)
    body = b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", 8820) + y.astype("<f4").tobytes()
    return b"RIFF" + struct.pack("<I", len(body)) + body


@query("read_files", "A5 A7 A8 A9", _READ)
def read_files(t: Tables) -> DataFrame:
    """Headers, chunks and decoding of several kinds of file; a broken one gives nulls."""

    def run(batches):
        for b in batches:
            rows = []
            for k in b["s_suppkey"]:
                content = _file(k)
                head, found, y = signal.header(content), signal.embedded(content), signal.decoded(content)
                seconds, rate, channels = head or (None, None, None)
                rows.append((f"/f/{k}", None if seconds is None else round(seconds, 6), rate, channels, int(found["acid"]["tempo"]) if found["acid"] else None, found["smpl"]["unity_note"] if found["smpl"] else None, None if y is None else len(y)))
            yield pd.DataFrame(rows, columns=["path", "seconds", "rate", "channels", "tempo", "note", "samples"]).astype({c: "Int64" for c in ("rate", "channels", "tempo", "note", "samples")})

    # keys of many files lie in one small file
    tasks = int(t.spark.conf.get("spark.sql.shuffle.partitions"))
    return t.supplier.select("s_suppkey").repartition(tasks).mapInPandas(run, "path string, seconds double, rate int, channels int, tempo int, note int, samples int")


@query("spectrograms", "E11", "SELECT '/tones/' || CAST(s_suppkey AS VARCHAR) || '.wav' AS path, CAST(44 AS INTEGER) AS frames, CAST(40 AS INTEGER) AS bands, TRUE AS tuned FROM supplier")
def spectrograms(t: Tables) -> DataFrame:
    """The levels of each tone on log-spaced bands: the loudest is the one that the pitch lies in."""
    centres = np.geomspace(1, signal.FRAME // 2, 40).round() * signal.RATE / signal.FRAME

    def run(batches):
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"], strict=True):
                s = signal.spectrogram(signal.decoded(content), 40)
                pitch = 220 + 10 * (int(path.split("/")[2].split(".")[0]) % 20)
                loudest = centres[int(s.mean(axis=0).argmax())]
                rows.append((path, len(s), s.shape[1], bool(abs(loudest - pitch) <= 2 * signal.RATE / signal.FRAME + 0.1 * pitch)))
            yield pd.DataFrame(rows, columns=["path", "frames", "bands", "tuned"])

    return _tones(t.supplier).mapInPandas(run, "path string, frames int, bands int, tuned boolean")


_SHAPES = [("first", 1), ("with facets", 2), ("with reviews", 3)]


@query("stored_shapes", "M10", _values(_SHAPES, "store, version"), fixed=True)
def stored_shapes(t: Tables) -> DataFrame:
    """The version of a store without a number, by the columns that its tables have."""
    classes = t.labels.select("doc_id", (F.col("toxic") == 1).alias("is_user_confirmed"))
    segments = t.labels.select(F.col("doc_id").alias("id"))
    facets = state.migrated("classification", classes, 1, 2)
    stores = [{"classification": classes, "segments": segments}, {"classification": facets, "segments": segments}, {"classification": facets, "segments": state.migrated("segments", segments, 2, 3)}]
    return t.spark.createDataFrame([(name, state.shape_version(s)) for (name, _), s in zip(_SHAPES, stores, strict=True)], "store string, version int")


@query("delivered_batches", "L2", _values([(0, 2), (1, 2), (2, 1)], "batch, files"), fixed=True)
def delivered_batches(t: Tables) -> DataFrame:
    """Five files delivered two at a time, at intervals."""
    folder = working.fresh(t.spark, "results")
    for n in range(5):
        t.spark.range(n, n + 1).coalesce(1).write.mode("append").parquet(folder)
    rows: list[tuple[int, int]] = []
    incremental.new_files(t.spark, folder, t.spark.range(0).schema, working.fresh(t.spark, "stream"), lambda df, n: rows.append((n, df.count())), most=2, every="1 second")
    return t.spark.createDataFrame(rows, "batch int, files int")


@query("tone_descriptors", "I1 I3 I5 I7 I9", f"SELECT '/tones/' || CAST(s_suppkey AS VARCHAR) || '.wav' AS path, {_PITCH} AS f0, TRUE AS steady, -6.0::DOUBLE AS peak_db, 1.4::DOUBLE AS crest, TRUE AS near, CAST(13 AS INTEGER) AS cepstra FROM supplier")
def tone_descriptors(t: Tables) -> DataFrame:
    """What one pass over each tone finds: its pitch, that it is steady, its levels, and a spectrum whose centre is near the pitch."""
    d = signal.described_files(_tones(t.supplier)).where("error is null")
    near = F.abs(F.col("d.spectral_centroid") - F.col("d.f0_hz")) < 150
    return d.select("path", F.round("d.f0_hz", -1).cast("long").alias("f0"), (F.col("d.harmonic_ratio") > 0.9).alias("steady"), F.round("d.peak_db", 1).alias("peak_db"), F.round("d.crest_factor", 1).alias("crest"), near.alias("near"), F.size("d.mfcc_mean").alias("cepstra"))


@query("click_tempos", "I6 I8 I9", "SELECT s_suppkey AS id, TRUE AS periodic, TRUE AS beaten, TRUE AS found FROM supplier")
def click_tempos(t: Tables) -> DataFrame:
    """Six seconds of clicks at 90 to 162 a minute: both tempo candidates are that, or a third, a half or twice of it, and nearly all clicks are onsets."""

    def run(batches):
        for b in batches:
            rows = []
            for k in b["s_suppkey"]:
                tempo = 90 + 8 * (k % 10)
                y = np.zeros(6 * signal.RATE, dtype=np.float32)
                at = (np.arange(0, 6 * tempo / 60 - 0.5) * 60 / tempo * signal.RATE).astype(int) + 2000
                noise = np.random.default_rng(1).standard_normal(400) * np.exp(-np.arange(400) / 60)
                for i in at[at < len(y) - 400]:
                    y[i : i + 400] += 0.5 * noise
                d = signal.described(y)
                near = lambda x: x is not None and min(abs(x / tempo - r) for r in (1 / 3, 1 / 2, 1, 2)) < 0.06  # noqa: B023, E731
                rows.append((k, bool(near(d["tempo_bpm"])), bool(near(d["beat_bpm"])), d["onset_count"] >= 0.8 * len(at)))
            yield pd.DataFrame(rows, columns=["id", "periodic", "beaten", "found"])

    tasks = int(t.spark.conf.get("spark.sql.shuffle.partitions"))
    return t.supplier.select("s_suppkey").repartition(tasks).mapInPandas(run, "id long, periodic boolean, beaten boolean, found boolean")


@query("exported_vectors", "A14 A13", "SELECT CASE WHEN label < 5 THEN 'sample' ELSE 'segment' END AS kind, vec_id AS id, CASE WHEN label >= 5 THEN 'auto' END AS method, '/lib/' || CAST(label AS VARCHAR) || '/' || CAST(vec_id AS VARCHAR) || '.wav' AS path, CASE WHEN label >= 5 THEN vec_id * 10 END AS start_ms, CASE WHEN label >= 5 THEN vec_id * 10 + 250 END AS end_ms, len(embedding) AS width, round(embedding[1]::DOUBLE, 6) AS first, round(embedding[len(embedding)]::DOUBLE, 6) AS last FROM embeddings WHERE embedding IS NOT NULL")
def exported_vectors(t: Tables) -> DataFrame:
    """Every vector written beside what it stands for (kind, id, method, path, bounds), and read back."""
    segment = F.col("label") >= 5
    path = F.concat(F.lit("/lib/"), F.col("label").cast("string"), F.lit("/"), F.col("vec_id").cast("string"), F.lit(".wav"))
    bound = lambda more: F.when(segment, F.col("vec_id") * 10 + more)
    rows = t.embeddings.where("embedding is not null").select(F.when(segment, "segment").otherwise("sample").alias("kind"), F.col("vec_id").alias("id"), F.when(segment, "auto").alias("method"), path.alias("path"), bound(0).alias("start_ms"), bound(250).alias("end_ms"), F.col("embedding").cast("array<float>").alias("vector"))
    folder = working.fresh(t.spark, "vectors")
    rows.write.partitionBy("kind").parquet(folder)
    back = t.spark.read.parquet(folder)
    end = lambda place: F.round(F.element_at("vector", place).cast("double"), 6)
    return back.select("kind", "id", "method", "path", "start_ms", "end_ms", F.size("vector").cast("long").alias("width"), end(1).alias("first"), end(-1).alias("last"))
