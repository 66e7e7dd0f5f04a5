"""Line deduplication by a deletion-neighbourhood join, in Spark SQL functions only.

Lines are compared by their words (cut at ASCII white space, case kept). Two lines are near when one word replaced,
added or left out turns one into the other (edit bound 1). A line goes if an earlier line (by key, then place) is equal
or near to it, whether or not that one stays itself; the earliest of a group stays.

* Equal lines meet by a hash of their words, joined by one blank, and count as one from there on. This pass over all lines
  works on strings in compiled code; arrays of words are made for the lines that go on.
* Two near lines share their first or their last half, so only lines that share a half and a word count (or one less or
  more) with another line go on; ``n`` words at the pair of lengths ``q - 1, q`` have a half of ``(q - 2) // 2`` words.
* Such a line emits every variant with one word left out, as hashed keys: with the place for replaced words, without for
  added or missing ones; a line itself is a variant without an omission. The earliest line of each key is an aggregate,
  so a key that thousands of lines share costs one row each and never pairs.
* From ``LONG_WORDS`` words on, blocks of words come first: a line emits one key per block, of the words around it, and only
  variants inside blocks whose key another line shares. A line of n words has some 2 sqrt(n) such keys, and sqrt(n) variants
  for each line that is near to it.
* The edit distance of a line and its earliest neighbour is verified on their words.

Lines below ``min_words`` words are compared for equality only; lines without words always stay. A line of any length is
one unit, unless ``max_words`` is given: then a longer one is handled as consecutive lines of that many words.
A line break goes with its line. Null texts stay null,
empty ones empty; rows with equal key and text get equal results; a null key sorts first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowmetrics.llm.common import free_name, parts_for, small
from flowmetrics.session import settle

SMALL_ROWS = 500_000
LONG_WORDS = 64


def _other_space(line: Column) -> Column:
    return F.contains(line, F.lit("\t")) | F.contains(line, F.lit("\r")) | F.contains(line, F.lit("\x0b")) | F.contains(line, F.lit("\f"))


def _words(line: Column) -> Column:
    return F.filter(F.when(_other_space(line), F.split(line, r"\s")).otherwise(F.split(line, " ")), lambda w: w != "")


def _plain(line: Column) -> Column:
    """The words of a line with one blank between them. Most lines are so already; only the others go through a pattern."""
    odd = line.startswith(" ") | line.endswith(" ") | F.contains(line, F.lit("  ")) | _other_space(line)
    return F.when(odd, F.trim(F.regexp_replace(line, r"\s+", " "))).otherwise(line)


def _held(value: Column, name: str) -> Column:
    """``value`` as the output of a generator, so that later expressions read it instead of computing it again."""
    return F.explode(F.array(value)).alias(name)


def lines_of(text: Column, max_words: int | None) -> Column:
    """All lines with their breaks, in pieces where they exceed ``max_words``; joined they give the text."""
    whole = F.regexp_extract_all(text, F.lit(r"[^\n]*\n|[^\n]+"), F.lit(0))
    if max_words is None:
        return whole
    pieces = F.lit(rf"\s*+(?:\S++\s*+){{1,{max_words}}}+")
    return F.flatten(F.transform(whole, lambda l: F.when(F.length(l) <= 2 * max_words, F.array(l)).when(F.size(F.split(l, r"\s+")) <= max_words, F.array(l)).otherwise(F.regexp_extract_all(l, pieces, F.lit(0)))))


def _id(key: str, text: str) -> Column:
    """Key, 64-bit hash and length of the text: rows that agree in them count as equal."""
    return F.struct(F.col(f"`{key}`").alias("key"), F.xxhash64(f"`{text}`").alias("th"), F.length(f"`{text}`").alias("size"))


def _units(text: Column, max_words: int) -> Column:
    """The words of all lines of a text, or of their pieces."""

    def cut(ws: Column) -> Column:
        last = F.floor((F.size(ws) - 1) / max_words).cast("int")
        return F.when(F.size(ws) <= max_words, F.array(ws)).otherwise(F.transform(F.sequence(F.lit(0), last), lambda j: F.slice(ws, j * max_words + 1, F.lit(max_words))))

    return F.flatten(F.transform(F.transform(F.split(text, "\n"), _words), cut))


def _numbered(docs: DataFrame, key: str, text: str, max_words: int | None) -> DataFrame:
    """``id`` (key and text hash), ``place``, ``line`` (its words with one blank between them), ``n`` (words) of every line with words."""
    whole = F.col(f"`{text}`")
    units = F.split(whole, "\n") if max_words is None else F.transform(_units(whole, max_words), lambda ws: F.array_join(ws, " "))
    rows = docs.select(_id(key, text).alias("id"), F.posexplode(units).alias("place", "unit"))
    rows = rows.select("id", "place", _held(_plain(F.col("unit")), "line")).where("line != ''")
    blanks = F.octet_length("line") - F.octet_length(F.replace("line", F.lit(" "), F.lit("")))
    return rows.select("id", "place", "line", _held(blanks + 1, "n"))


def _halves(line: Column, n: Column, min_words: int) -> Column:
    """Hashes of the first and the last half, as a shorter or equal line and as a longer or equal line of a pair.

    Cut from the line itself, without an array of its words: every line of every text comes here.
    """

    def half(q: Column) -> list[Column]:
        p = F.greatest(F.lit(1), F.floor((q - 2) / 2).cast("int"))
        first, last = (F.call_function("substring_index", line, F.lit(" "), count) for count in (p, -p))
        return [F.hash(F.lit(0), q, first), F.hash(F.lit(1), q, last)]

    return F.when(n >= min_words, F.array(*half(n), *half(n + 1)))


def _distance_is_one(a: Column, b: Column) -> Column:
    """True if the word arrays differ by at most one replaced, added or missing word."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, e: F.struct((s["n"] + F.when(s["on"] & e, 1).otherwise(0)).alias("n"), (s["on"] & e).alias("on")), lambda s: s["n"])
    size = F.greatest(F.size(a), F.size(b))
    rest = lambda w, skip: F.slice(w, same + 1 + skip, size)
    return (
        F.when(F.size(a) == F.size(b), rest(a, 1) == rest(b, 1)).when(F.size(a) == F.size(b) + 1, rest(a, 1) == rest(b, 0))
        .when(F.size(b) == F.size(a) + 1, rest(b, 1) == rest(a, 0)).otherwise(False)
    )


def _open(n: Column) -> tuple[Column, Column]:
    """First and last word to leave out: a line that shares its first half is edited behind it, one that shares its last
    half before that."""
    half = F.floor((n - 2) / 2).cast("int")
    return F.when(F.col("last") == 1, F.lit(0)).otherwise(half), F.when(F.col("not_first") == 0, n - 1).otherwise(n - half - 1)


def _blocks(q: Column) -> Column:
    """Words in a block of a pair whose longer line has ``q`` words."""
    return F.ceil(F.sqrt(q)).cast("int")


def _shared_blocks(spelt: DataFrame) -> DataFrame:
    """``at, blocks`` of the lines from ``LONG_WORDS`` words on: the blocks of ``sqrt(n)`` words in which a line may differ from another.

    A line of ``n`` words is the longer or equal one of a pair with ``q = n`` words, and the shorter one with ``q = n + 1``. For
    each block its key is the hash of the words before and behind it. One edit lies in one block of the longer line, so near
    lines agree in the words around that block, and in its key, whatever happens inside. Lines one word below are the shorter
    ones of such pairs.
    """
    long = spelt.where(F.size("words") >= LONG_WORDS - 1).select("at", _held(F.transform("words", lambda w: F.xxhash64(w)), "hw"))
    n = F.size("hw")

    def keys(q: Column, own: int) -> Column:
        size = _blocks(q)

        def key(j: Column) -> Column:
            behind = F.greatest(F.lit(0), q - (j + 1) * size)
            return F.struct(j.alias("j"), F.lit(own).alias("own"), F.xxhash64(q, j, F.slice("hw", F.lit(1), F.least(n, j * size)), F.slice("hw", n - behind + 1, behind)).alias("k"))

        return F.transform(F.sequence(F.lit(0), F.floor((q - 1) / size).cast("int")), key)

    rows = settle(long.select("at", F.explode(F.concat(keys(n, 1), keys(n + 1, 0))).alias("b")).select("at", "b.*"))
    shared = settle(rows.groupBy("k").agg(F.count("*").alias("rows")).where("rows > 1").select("k"))
    return rows.where("own = 1").join(small(shared, SMALL_ROWS), "k", "left_semi").groupBy("at").agg(F.collect_set("j").alias("blocks"))


def _words_of(docs: DataFrame, key: str, text: str, max_words: int | None, firsts: DataFrame) -> DataFrame:
    """The words of the lines in ``firsts`` (``h1, h2, first, last, not_first``): only documents that hold one are cut into
    lines again, and only those lines into words."""
    wanted = F.struct(F.col("first.place").alias("place"), "h1", "h2", "last", "not_first")
    needed = settle(firsts.groupBy(F.col("first.id").alias("id")).agg(F.collect_list(wanted).alias("wanted")))
    holders = docs.select(_id(key, text).alias("id"), F.col(f"`{text}`").alias("text")).join(small(needed, SMALL_ROWS), "id")
    units = F.split("text", "\n") if max_words is None else _units(F.col("text"), max_words)
    found = holders.select("id", "wanted", _held(units, "units")).select("id", "units", F.explode("wanted").alias("w"))
    unit = F.get("units", F.col("w.place"))
    spelt = found.select(F.struct("id", "w.place").alias("first"), "w.h1", "w.h2", "w.last", "w.not_first", (_words(unit) if max_words is None else unit).alias("words"))
    # equal rows give the same line more than once
    return spelt.groupBy("h1", "h2", "first", "last", "not_first").agg(F.first("words").alias("words"))


def near_lines(docs: DataFrame, key: str, text: str, max_words: int | None, classes: DataFrame) -> DataFrame:
    """``h1, h2`` of the distinct lines of ``docs`` to which an earlier line is near.

    ``classes``: distinct lines ``h1, h2, first, halves``.
    """
    halves = classes.where("halves is not null").select("h1", "h2", F.posexplode("halves").alias("side", "half"))
    shared = settle(halves.select("half").groupBy("half").count().where("count > 1").select("half"))
    able = halves.join(small(shared, SMALL_ROWS), "half", "left_semi").groupBy("h1", "h2")
    able = settle(able.agg(F.max((F.col("side") % 2).cast("int")).alias("last"), F.min((F.col("side") % 2).cast("int")).alias("not_first")))
    firsts = classes.select("h1", "h2", "first").join(small(able, SMALL_ROWS), ["h1", "h2"])
    spelt = _words_of(docs, key, text, max_words, firsts)
    count = parts_for(docs.sparkSession, 1, 1)
    ordered = spelt.repartitionByRange(count, "first").sortWithinPartitions("first")
    spelt = settle(ordered.select("h1", "h2", "last", "not_first", F.monotonically_increasing_id().alias("at"), "words"))

    n = F.size("hw")
    low, high = _open(n)
    spelt_blocks = spelt.join(small(settle(_shared_blocks(spelt)), SMALL_ROWS), "at", "left")
    keys = spelt_blocks.select("at", "last", "not_first", "blocks", _held(F.transform("words", lambda w: F.xxhash64(w)), "hw"))
    size = _blocks(n)
    inside = F.flatten(F.transform(F.coalesce("blocks", F.array().cast("array<int>")), lambda j: F.sequence(j * size, F.least(n - 1, (j + 1) * size - 1))))
    left = F.when(n < LONG_WORDS, F.sequence(low, high)).otherwise(F.filter(inside, lambda i: (i >= low) & (i <= high)))
    rests = F.transform(left, lambda i: F.struct(i.alias("i"), F.xxhash64(F.slice("hw", F.lit(1), i), F.slice("hw", i + 2, n)).alias("rest")))
    keys = keys.select("at", n.alias("n"), F.explode(F.concat(F.array(F.struct(F.lit(-1).alias("i"), F.xxhash64("hw").alias("rest"))), rests)).alias("v"))
    left_out = F.array(F.struct(F.xxhash64(F.lit("s"), "n", "v.i", "v.rest").alias("k"), F.lit(2).alias("side")), F.struct(F.col("v.rest").alias("k"), F.lit(1).alias("side")))
    whole = F.array(F.struct(F.col("v.rest").alias("k"), F.lit(0).alias("side")))
    keys = settle(keys.select("at", F.explode(F.when(F.col("v.i") < 0, whole).otherwise(left_out)).alias("w")).select("at", "w.k", F.col("w.side").cast("byte").alias("side")))
    least = [F.min(F.when(F.col("side") == s, F.col("at"))).alias(f"m{s}") for s in range(3)]
    groups = keys.groupBy("k").agg(*least, F.count("*").alias("rows")).where("rows > 1").drop("rows")
    other = F.when(F.col("side") == 0, F.col("m1")).when(F.col("side") == 1, F.col("m0")).otherwise(F.col("m2"))
    links = keys.join(groups, "k").select("at", other.alias("earlier")).where("earlier < at").groupBy("at").agg(F.min("earlier").alias("earlier"))
    pairs = links.join(spelt, "at").join(spelt.select(F.col("at").alias("earlier"), F.col("words").alias("other")), "earlier")
    return pairs.where(_distance_is_one(F.col("words"), F.col("other"))).select("h1", "h2")


def dropped_lines(docs: DataFrame, key: str, text: str, min_words: int = 5, max_words: int | None = None) -> DataFrame:
    """``id, gone``: for every document that loses lines their places, ascending."""
    numbered = _numbered(docs, key, text, max_words)
    hashed = settle(numbered.select("id", "place", F.xxhash64("line").alias("h1"), F.hash("line").alias("h2"), _halves(F.col("line"), F.col("n"), min_words).alias("halves")))
    place = F.struct("id", "place")
    classes = settle(hashed.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.first("halves").alias("halves"), F.count("*").alias("copies")))
    near = settle(near_lines(docs, key, text, max_words, classes))
    verdict = classes.where("copies > 1").select("h1", "h2", "first").join(near.withColumn("near", F.lit(True)), ["h1", "h2"], "full")
    gone = hashed.select("id", "place", "h1", "h2").join(small(settle(verdict), SMALL_ROWS), ["h1", "h2"]).where(F.col("near") | (place != F.col("first")))
    return gone.select("id", "place").distinct().groupBy("id").agg(F.sort_array(F.collect_list("place")).alias("gone"))


def dedup_lines(docs: DataFrame, key: str, text: str, min_words: int = 5, max_words: int | None = None) -> DataFrame:
    """``docs`` with the kept lines as text, and two more columns: ``lines`` (all) and ``gone`` (places of removed ones)."""
    gone = dropped_lines(docs, key, text, min_words, max_words)
    own, lines, left, parts = (free_name(docs.columns, n) for n in ("id", "lines", "gone", "parts"))
    joined = docs.withColumn(own, _id(key, text)).join(gone.select(F.col("id").alias(own), F.col("gone").alias(left)), own, "left")
    joined = joined.select(*[F.col(f"`{c}`") for c in docs.columns], F.coalesce(left, F.array().cast("array<int>")).alias(left), _held(lines_of(F.coalesce(F.col(f"`{text}`"), F.lit("")), max_words), parts))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(left)), lambda i: F.get(parts, i))
    new = F.array_join(kept, "")
    new = F.when(new.endswith("\n") & ~F.col(f"`{text}`").endswith("\n"), F.regexp_replace(new, r"\n\z", "")).otherwise(new)
    changed = F.when(F.size(left) == 0, F.col(f"`{text}`")).otherwise(new)
    return joined.select(*[changed.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns], F.size(parts).alias(lines), left)


ORACLE_SQL = """
with lines as (
    select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as line_no
    from documents
), worded as (
    select doc_id, line_no, list_filter(regexp_split_to_array(line, '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '') as words,
           line, count(*) over (partition by doc_id) as n
    from lines
), numbered as (
    select *, row_number() over (partition by doc_id order by line_no) - 1 as place from worded where not (line = '' and line_no = n)
), ranked as (
    select *, row_number() over (order by doc_id, place) as pos from numbered where len(words) > 0
), classes as (
    select array_to_string(words, ' ') as spelt, any_value(words) as words, min(pos) as first from ranked group by 1
), variants as (
    select spelt, first, -1 as i, len(words) as n, hash(words) as rest from classes where len(words) >= 5
    union all
    select spelt, first, i, len(words), hash(list_concat(list_slice(words, 1, i), list_slice(words, i + 2, len(words))))
    from (select *, unnest(range(0, len(words))) as i from classes where len(words) >= 5)
), near as (
    select a.spelt from variants a join variants b on a.rest = b.rest and b.first < a.first
     and ((a.i >= 0 and a.i = b.i and a.n = b.n) or (a.i = -1 and b.i >= 0) or (a.i >= 0 and b.i = -1)) group by 1
), gone as (
    select r.doc_id, r.place from ranked r join classes c on array_to_string(r.words, ' ') = c.spelt
    where r.pos <> c.first or c.spelt in (select spelt from near)
), totals as (
    select doc_id, string_agg(place::varchar, ',' order by place) as removed, count(*) as n_removed from gone group by 1
)
select d.doc_id, coalesce(n.n, 0) as n_lines, coalesce(t.n_removed, 0) as n_removed, coalesce(t.removed, '') as removed
from documents d left join (select doc_id, count(*) as n from numbered group by 1) n using (doc_id) left join totals t using (doc_id)
"""
