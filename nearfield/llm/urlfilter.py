"""URL filters by a temporal list join.

Lists change: each entry has a time, and adds a pattern to a list or removes it.
The entries of a pattern become validity intervals [since, until), and a capture
is judged by those that were active when it was fetched, to the microsecond: an
as-of join.

Patterns are of two kinds.  `domain` holds for a host and all hosts below it;
`prefix` (host/path) holds for paths of just this host that begin with the same
segments, and without a path for all of them.  A URL is parsed once, and looked
up by equality: its host's parents and its path's prefixes, of those lengths that
the list has.  A pattern that holds much of the captures meets its intervals by
broadcast (at most HOT patterns, found by their counts).  Between the tables go
two hashes of a URL (128 bits) and the time, not the URL.

Defined cases: a null URL, a null time, or a URL without a scheme and host is
never blocked; scheme, port and user are left out, of captures and of patterns;
hosts are compared in lower case, without a dot at either end or "*." before
them; empty segments, query and fragment are left out; a date is the midnight it
begins with; at one time a removal comes after an addition; entries that repeat
change nothing; entries with a null field, of another kind, with an action other
than add and remove, or without a host are left out; rows repeat as they came, and all their columns, of any type, pass through, but for
those named `blocked` and `lists`, which are replaced; empty tables block nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearfield.llm._io import dropped, stored

#: Patterns that meet more than a HOT-th of all questions: HOT of them at most.
HOT = 4096
_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*://"


def host_of(url: Column) -> Column:
    """Lower-case host without user and port; '' for none."""
    authority = F.regexp_extract(url, _SCHEME + "([^/?#]*)", 1)
    return F.lower(F.regexp_replace(F.regexp_replace(authority, "^.*@", ""), ":[0-9]*$", ""))


def segments_of(url: Column) -> Column:
    """The path's segments without empty ones."""
    return F.filter(F.split(F.regexp_extract(url, _SCHEME + "[^/?#]*([^?#]*)", 1), "/"), lambda s: s != "")


def normalised(kind: Column, pattern: Column) -> Column:
    """A pattern as URLs are compared with it: a host, or host/segments; null for none."""
    url = F.concat(F.lit("x://"), F.regexp_replace(F.trim(pattern), _SCHEME, ""))
    host = _bare(F.regexp_replace(host_of(url), r"^\*", ""))
    path = F.concat(host, F.lit("/"), F.array_join(segments_of(url), "/"))
    return F.when(host != "", F.when(kind == "domain", host).when(kind == "prefix", path))


def _bare(host: Column) -> Column:
    return F.regexp_replace(host, r"^\.+|\.+$", "")


def validity(entries: DataFrame, at: str = "day") -> DataFrame:
    """Timed entries (list, kind, pattern, action, `at`) as intervals (list, kind, pattern, since, until); until is null while it holds."""
    own = entries.select("list", "kind", normalised(F.col("kind"), F.col("pattern")).alias("pattern"), "action", F.col(at).cast("timestamp").alias("at"))
    sound = own.dropna().where(F.col("action").isin("add", "remove")).distinct()
    by = Window.partitionBy("list", "kind", "pattern").orderBy("at", "action")
    ended = sound.withColumn("until", F.lead("at").over(by))
    return ended.where("action = 'add' and (until is null or until > at)").select("list", "kind", "pattern", F.col("at").alias("since"), "until")


def _depths(patterns: DataFrame) -> tuple[Column, Column]:
    """Numbers of labels of domains and of segments of prefixes in the list, as two constant arrays."""
    path = F.element_at(F.split("pattern", "/", 2), 2)
    count = F.when(F.col("kind") == "domain", F.size(F.split("pattern", r"\."))).otherwise(F.when(path == "", 0).otherwise(F.size(F.split(path, "/"))))
    found = {r["kind"]: sorted(r["n"]) for r in patterns.groupBy("kind").agg(F.collect_set(count).alias("n")).collect()}
    return tuple(F.lit(found.get(kind, [])).cast("array<int>") for kind in ("domain", "prefix"))


def judged(captures: DataFrame, entries: DataFrame, url: str = "url", day: str = "day", *, entry_time: str = "day") -> DataFrame:
    """`captures` with `blocked` and `lists`, the names of the lists that had the URL at its time (column `day`: a time or a date), sorted and joined by commas."""
    one = F.struct("list", "since", "until")
    patterns = stored(validity(entries, entry_time).groupBy("kind", "pattern").agg(F.collect_list(one).alias("spans")))
    domains, prefixes = _depths(patterns)
    address, at = captures[url].cast("string"), captures[day].cast("timestamp")
    asks = address.isNotNull() & at.isNotNull()
    hashes = {f"_h{seed}": F.xxhash64(F.lit(seed), address) for seed in (1, 2)}
    # rows that ask nothing are dealt by their place
    key = [F.when(asks, h).otherwise(F.xxhash64(F.monotonically_increasing_id())).alias(n) for n, h in hashes.items()]
    asked = captures.where(asks).select(*(h.alias(n) for n, h in hashes.items()), at.alias("_at"), _bare(host_of(address)).alias("host"), segments_of(address).alias("segs")).where("host <> ''").dropDuplicates(["_h1", "_h2", "_at"])
    labels = F.split("host", r"\.")
    hosts = F.transform(F.filter(domains, lambda n: n <= F.size(labels)), lambda n: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, -n, n), ".").alias("pattern")))
    paths = F.transform(F.filter(prefixes, lambda n: n <= F.size("segs")), lambda n: F.struct(F.lit("prefix").alias("kind"), F.concat("host", F.lit("/"), F.array_join(F.slice("segs", 1, n), "/")).alias("pattern")))
    keyed = stored(asked.select("_h1", "_h2", "_at", F.explode(F.concat(hosts, paths)).alias("key")).select("_h1", "_h2", "_at", "key.*"))
    counts = keyed.groupBy("kind", "pattern").agg(F.count("*").alias("n"))
    often = stored(counts.where(F.col("n") > keyed.count() / HOT).select("kind", "pattern"))
    hot = F.broadcast(often)
    met = keyed.join(F.broadcast(patterns.join(hot, ["kind", "pattern"])), ["kind", "pattern"]).unionByName(keyed.join(hot, ["kind", "pattern"], "left_anti").join(patterns, ["kind", "pattern"]))
    active = F.filter("spans", lambda s: (s["since"] <= F.col("_at")) & (s["until"].isNull() | (F.col("_at") < s["until"])))
    hits = met.select("_h1", "_h2", "_at", F.explode(F.transform(active, lambda s: s["list"])).alias("list"))
    verdicts = stored(hits.groupBy("_h1", "_h2", "_at").agg(F.array_join(F.array_sort(F.collect_set("list")), ",").alias("_lists")))
    dropped(patterns, keyed, often)
    kept = [c for c in captures.columns if c not in ("blocked", "lists")]
    inner = captures.select(*(captures[c].alias(f"c{i}") for i, c in enumerate(kept)), *key, at.alias("_at"))
    out = inner.join(verdicts, ["_h1", "_h2", "_at"], "left")
    return out.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(kept)), F.col("_lists").isNotNull().alias("blocked"), F.coalesce("_lists", F.lit("")).alias("lists"))


#: The first second of 2023 (UTC), from which the made times count, and a day.
_BEGIN, _DAY = 1_672_531_200, 86_400


def dated_captures(pages: DataFrame) -> DataFrame:
    """pages with a fetch time, of two years from 2023 on, that follows from the page's number."""
    second = F.pmod(F.col("page_id") * 37, F.lit(730)) * _DAY + F.pmod(F.col("page_id") * 7919, F.lit(_DAY))
    return pages.select("page_id", "url", F.timestamp_seconds(second + _BEGIN).alias("fetched_at"))


def sample_entries(pages: DataFrame) -> DataFrame:
    """A timed list made from the hosts of pages: digits of their MD5 say which are listed, when, and for how long."""
    parts = pages.where("url is not null").select(host_of(F.col("url")).alias("host"), segments_of(F.col("url")).alias("segs")).where("host <> ''")
    entry = lambda name, kind, pattern: F.struct(F.lit(name).alias("list"), F.lit(kind).alias("kind"), pattern.alias("pattern"))
    host, labels = F.col("host"), F.split("host", r"\.")
    own = entry("unsafe", "domain", host)
    parent = F.when(F.size(labels) > 2, entry("parked", "domain", F.array_join(F.slice(labels, -3, 3), ".")))
    path = F.when(F.size("segs") > 0, entry("spam", "prefix", F.concat(host, F.lit("/"), F.try_element_at("segs", F.lit(1)))))
    named = parts.select(F.explode(F.array_compact(F.array(own, parent, path))).alias("e")).select("e.*").distinct().withColumn("m", F.md5(F.concat_ws("|", "list", "pattern")))
    number = lambda a, n: F.conv(F.substring("m", a, n), 16, 10).cast("int")
    listed = named.where(number(1, 1) < 6).withColumn("begin", number(2, 3) % 600 * _DAY + number(9, 4) + _BEGIN)
    gap = number(6, 2) * _DAY
    act = lambda action, second: F.struct(F.lit(action).alias("action"), F.timestamp_seconds(second).alias("at"))
    acts = F.array_compact(F.array(act("add", F.col("begin")), F.when(number(5, 1) < 8, act("remove", F.col("begin") + gap)), F.when(number(5, 1) < 3, act("add", F.col("begin") + gap + 90 * _DAY))))
    return listed.select("list", "kind", "pattern", F.explode(acts).alias("a")).select("list", "kind", "pattern", "a.*")
