"""Fuzzy line deduplication: MinHash, banding, exact verification, union-find.

DataFrame functions only. Lines are trimmed and lower-cased; equal lines share
128 bits and are one line from there on. A line's character shingles are its
windows of `SHINGLE` characters. The signature hashes all of them and takes the
least under 21 permutations, xor with fixed numbers; 7 bands of 3 make 7 band
keys (two lines that are alike at 0.8 share one with probability 0.993, and agree
in `AGREE` minima or more, as candidates must, with 0.9985). Lines
that share a band key first meet the least and the greatest line of that key, so
a group of n lines gives 2 n candidates; those of a group that are then in
different components meet each other too. Thus the components are those of all
pairs that share a band, and near copies cost no square of their number; n lines
that share a band and are not alike do. Candidates are verified by the exact
Jaccard similarity of all their windows, and distributed union-find joins what
passes. Of each component the line first in order of (doc_id, place) stays; the
others leave their documents.

Windows are cut from lines written with four bytes a character, where each is a
slice at a known place. They are exploded and combined again before any shuffle,
so what is shuffled is a row per line; a line that fills a third of the corpus
is one row per task. Graph nodes are the first 64 of a line's bits; of two
different lines with the same 64 neither is compared with others. Texts are
shuffled for verification and for rewriting only where they are needed: bitmaps
of bounded size (`BITS`, broadcast) tell most other rows apart, and a full
bitmap lets more rows through but changes no result.

What 0.8 means: one character changed inside a line of L characters takes 10
windows from each side, and (L - 19) / (L + 1) is at least 0.8 from L = 99 on.
A shorter line with such a change (a year, a digit) is another line here; only
a change within its last or first characters can leave it a duplicate.

Defined results: lines without a word are kept as they are and never compared;
a null text stays null; of rows that are equal in id and text the first keeps
its lines and the others lose all; null ids come first in order; an empty table
gives an empty result; other columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, discard, stored, table
from .components import connected_components

SHINGLE = 10
BANDS, ROWS = 7, 3
#: Of 21 minima two lines that are alike at 0.8 agree in 16.8 on average, and in fewer than 11 one time in 700.
AGREE = 11
#: Least and most bits of a bitmap; the most is broadcast as 2 ** 20 longs.
BITS = 1 << 22, 1 << 26
#: Lines to a side of a cell, where lines of one band meet.
CELL = 256
#: Windows hashed in one row, so that the minima of a row's windows are taken before they are gathered.
BLOCK = 16
#: Words of 64 bits that mark a line's windows where lines of one band meet.
WORDS = 32
#: By how much 32-bit hashes of windows may misjudge a similarity: four windows of 400, where one collides in 10 000 pairs.
MARGIN = 0.01
MIX = 0x9E3779B97F4A7C15


def _permutations(n: int) -> list[int]:
    """Numbers to xor hashes with, from a multiplicative sequence, as signed 32-bit numbers."""
    out = []
    for k in range(1, n + 1):
        x = k * MIX & (1 << 64) - 1
        x = (x ^ x >> 31) * 0xBF58476D1CE4E5B9 & (1 << 64) - 1
        x = (x ^ x >> 27) >> 32
        out.append(x - (1 << 32) if x >> 31 else x)
    return out


def normal(line: Column) -> Column:
    return F.lower(F.trim(line, F.lit(SPACES)))


def wide(line: Column) -> Column:
    """Four bytes a character: a window is then a slice at a known place, in any script."""
    return F.encode(line, "UTF-32")


def window_starts(wide_line: Column) -> Column:
    """Where windows start, in bytes from 1; a line shorter than a window is one window."""
    return F.sequence(F.lit(1), F.greatest(F.lit(1), F.octet_length(wide_line) - (4 * SHINGLE - 1)), F.lit(4))


def window(wide_line: Column, start: Column) -> Column:
    return F.substring(wide_line, start, F.lit(4 * SHINGLE))


def windows(line: Column, of=F.xxhash64) -> Column:
    """Hashes of a line's windows, as an array."""
    # The array of one value has the line written wide once, not for each window.
    return F.transform(F.array(wide(line)), lambda w: F.transform(window_starts(w), lambda at: of(window(w, at))))[0]


def distinct_windows(line: Column, of=F.xxhash64) -> Column:
    return F.array_distinct(windows(line, of))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays without repeats."""
    either = F.size(F.array_union(a, b))
    return (F.size(a) + F.size(b) - either) / either


def bits_for(n: int) -> int:
    """16 bits a key, within BITS."""
    return min(BITS[1], max(BITS[0], 1 << (16 * n).bit_length()))


def bitmap(keys: DataFrame, key: str) -> tuple[DataFrame, int]:
    """(word, mask): the bits of all keys' values, at most BITS[1] / 64 rows; and how many bits there are."""
    bits = bits_for(keys.count())
    bit = F.pmod(F.xxhash64(key), F.lit(bits))
    return keys.groupBy(F.floor(bit / 64).cast("int").alias("__word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(xxhash64(`{key}`), {bits}) % 64 as int))")).alias("__mask")), bits


def marked(rows: DataFrame, key: str, made: tuple[DataFrame, int]) -> DataFrame:
    """rows with __hit: whether the bitmap has the key. Its size is bounded, so it is broadcast."""
    words, bits = made
    place = F.pmod(F.xxhash64(key), F.lit(bits))
    rows = rows.withColumns({"__w": F.floor(place / 64).cast("int"), "__b": (place % 64).cast("int")})
    found = rows.join(F.broadcast(words), F.col("__w") == F.col("__word"), "left")
    return found.withColumn("__hit", F.coalesce(F.getbit("__mask", "__b") == 1, F.lit(False))).drop("__w", "__b", "__word", "__mask")


def row_key(doc_id: str, text: str) -> Column:
    """With the id itself this tells rows apart."""
    return F.xxhash64(F.col(f"`{doc_id}`"), F.col(f"`{text}`"))


def lines_of(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """One row for each line with a word: doc and rid (the row), pos, line, and
    key and key2, 128 bits that stand for the line."""
    # The row's key is found below the explode: beside it, the whole text would be hashed for each of its lines.
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc"), row_key(doc_id, text).alias("rid"), F.col(f"`{text}`").alias("body"))
    split = rows.select("doc", "rid", F.posexplode(F.split("body", "\n", -1)).alias("pos", "raw"))
    lines = split.where(F.col("raw").rlike(r"[^\x20\x09-\x0D]")).select("doc", "rid", "pos", normal(F.col("raw")).alias("line"))
    return lines.withColumns({"key": F.xxhash64("line"), "key2": F.xxhash64(F.lit(1), "line")})


def window_hashes(lines: DataFrame, block: int, *cols: str) -> DataFrame:
    """32-bit hashes of all windows of the wide lines `w`, `block` of them a row:
    cols, last (where the last window starts), at (where the first of the row
    does) and h0, h1, ...; a line's last
    window fills its last row, so rows say nothing about how often it occurs."""
    each = lines.select(*cols, "w", F.greatest(F.lit(1), F.octet_length("w") - (4 * SHINGLE - 1)).alias("last"))
    each = each.select(*cols, "w", "last", F.explode(F.sequence(F.lit(1), F.col("last"), F.lit(4 * block))).alias("at"))
    return each.select(*cols, "last", "at", *[F.hash(window(F.col("w"), F.least(F.col("at") + 4 * k, F.col("last")))).alias(f"h{k}") for k in range(block)])


def signatures(lines: DataFrame) -> DataFrame:
    """A row for each different line: key, many (whether it is there more than
    once) and sig (array of minima). A key that two different lines share has no
    sig and takes no part: those are only ever equal to others."""
    hashed = window_hashes(lines.select("key", "key2", wide(F.col("line")).alias("w")), BLOCK, "key", "key2")
    # Only numbers are gathered here, so this stays a hash aggregation; places are structs, which would have all windows sorted.
    least = [F.min(F.least(*[F.col(f"h{i}").bitwiseXOR(F.lit(x)) for i in range(BLOCK)])).alias(f"m{k}") for k, x in enumerate(_permutations(BANDS * ROWS))]
    grouped = hashed.groupBy("key").agg(F.min("key2").alias("k"), F.max("key2").alias("k2"), F.count_if(F.col("at") == 1).alias("n"), *least)
    return grouped.select("key", (F.col("n") > 1).alias("many"), F.when(F.col("k") == F.col("k2"), F.array(*[f"m{k}" for k in range(BANDS * ROWS)])).alias("sig"))


def marks(texts: DataFrame) -> DataFrame:
    """(key, n, marks): how many windows each line has, repeats included, and the
    bits of their hashes in WORDS words. A bit that only one of two lines has is
    a window that only that line has, and another one for each bit."""
    hashed = window_hashes(texts.select("key", wide(F.col("line")).alias("w")), BLOCK // 2, "key")
    at = range(BLOCK // 2)
    each = hashed.select("key", "last", *[F.expr(f"shiftleft(1L, h{i})").alias(f"b{i}") for i in at], *[F.expr(f"shiftrightunsigned(h{i}, 6) % {WORDS}").alias(f"w{i}") for i in at])
    word = lambda k: F.expr("bit_or(" + " | ".join(f"if(w{i} = {k}, b{i}, 0L)" for i in at) + ")")
    grouped = each.groupBy("key").agg(F.max("last").alias("last"), *[word(k).alias(f"m{k}") for k in range(WORDS)])
    return grouped.select("key", F.expr("(last - 1) div 4 + 1").alias("n"), F.array(*[f"m{k}" for k in range(WORDS)]).alias("marks"))


def possible(ma: Column, na: Column, mb: Column, nb: Column, similarity: float) -> Column:
    """Whether lines of these marks and numbers of windows can be alike; no pair
    that is alike fails. |A and B| / |A or B| >= s says that at most
    (1 - s) / (1 + s) * (|A| + |B|) windows are in one line only."""
    # Word by word: a function over the arrays would be interpreted for each pair.
    apart = sum((F.bit_count(ma[k].bitwiseXOR(mb[k])) for k in range(WORDS)), F.lit(0))
    return apart <= F.lit((1 - similarity) / (1 + similarity) + 1e-9) * (na + nb)


def bands_of(sig: Column) -> Column:
    return F.array(*[F.xxhash64(F.lit(b), *[sig[b * ROWS + r] for r in range(ROWS)]) for b in range(BANDS)])


def likely(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """Of pairs (a, b) of keys those whose signatures agree in AGREE minima or more."""
    both = pairs.join(found.select(F.col("key").alias("a"), F.col("sig").alias("sa")), "a").join(found.select(F.col("key").alias("b"), F.col("sig").alias("sb")), "b")
    return both.where(agreed(F.col("sa"), F.col("sb")) >= AGREE).select("a", "b")


def agreed(a: Column, b: Column) -> Column:
    return sum(((a[k] == b[k]).cast("int") for k in range(BANDS * ROWS)), F.lit(0))


def places_of(lines: DataFrame) -> DataFrame:
    """A row for each different line: key, key2, its first place and how many it has."""
    return lines.groupBy("key", "key2").agg(F.min(F.struct("doc", "rid", "pos")).alias("first"), F.count("*").alias("n"))


def alike(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Of pairs (a, b) of keys those whose windows' Jaccard similarity is at least `similarity`."""
    # Texts travel, not their windows, which are eight times as large; a pair's sets exist in its own row only.
    sides = pairs.join(texts.select(F.col("key").alias("a"), F.col("line").alias("la")), "a").join(texts.select(F.col("key").alias("b"), F.col("line").alias("lb")), "b")
    # An exploded value is computed once; a plain column would be computed again for each use.
    sets = sides.select("a", "b", F.explode(F.array(F.struct(distinct_windows(F.col("la")).alias("a"), distinct_windows(F.col("lb")).alias("b")))).alias("s"))
    sized = sets.select("a", "b", F.explode(F.array(jaccard(F.col("s.a"), F.col("s.b")))).alias("similarity"))
    return sized.where(F.col("similarity") >= similarity).select("a", "b")


def open_pairs(members: DataFrame, linked: DataFrame, lines: DataFrame, found: DataFrame, similarity: float) -> DataFrame:
    """(a, b): the pairs of each band that could still join two components and
    are alike by their marks, which tell most pairs apart, and then by 32-bit hashes of their
    windows, but for a margin that collisions of hashes cannot fill. A band's lo and hi have met all its members, and
    members of its most frequent component need not meet each other. Two lines
    meet in the least band that they share: if that is not open, or one of them is
    its lo or hi, they have met or are in one component already. Large bands
    are dealt into cells of about CELL times CELL lines; a line's marks and
    windows are found once and go with it to its cells."""
    left = members.where("n > 3 AND key <> lo AND key <> hi").select("key", "band")
    named = left.join(linked.withColumnRenamed("node", "key"), "key", "left").select("key", "band", F.coalesce("component", "key").alias("c"))
    named = stored(named, "open")
    sizes = named.groupBy("band", "c").agg(F.count("*").alias("k")).groupBy("band").agg(F.sum("k").alias("n"), F.max(F.struct("k", "c")).alias("most"))
    sizes = sizes.where("n > most.k").select("band", F.col("most.c").alias("most"), F.ceil((F.col("n") - F.col("most.k")) / CELL).cast("int").alias("rows"), F.ceil(F.col("n") / CELL).cast("int").alias("cols"))
    sized = stored(marked(named, "band", bitmap(sizes, "band")).where("__hit").drop("__hit").join(sizes, "band"), "open-members")
    keys = sized.select("key").distinct()
    few = bitmap(keys, "key")
    texts = marked(lines.select("key", "line"), "key", few).where("__hit").groupBy("key").agg(F.min("line").alias("line")).join(keys, "key", "left_semi")
    texts = stored(texts, "open-texts")
    sets = marks(texts).join(texts.select("key", distinct_windows(F.col("line"), F.hash).alias("set")), "key")
    sig = F.col("sig") if "sig" in found.columns else F.lit(None).cast("array<int>").alias("sig")
    sets = sets.join(marked(found.select("key", "bands", sig), "key", few).where("__hit").drop("__hit"), "key")
    sets = stored(sets.select("key", F.struct("sig", "n", "marks", "bands", "set").alias("of")), "open-windows")
    carried = sized.join(sets, "key")
    part = lambda of: F.pmod(F.xxhash64("key", "band"), F.col(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    few = carried.where("c <> most").select("band", part("rows").alias("i"), every("cols").alias("j"), F.col("key").alias("a"), F.col("c").alias("ca"), F.col("of").alias("oa"))
    all_ = carried.select("band", every("rows").alias("i"), part("cols").alias("j"), F.col("key").alias("b"), F.col("c").alias("cb"), "most", F.col("of").alias("ob"))
    # Cells are dealt once: they are small, and a skewed join would be split in bytes, each piece with all that it meets.
    few, all_ = few.repartition("band", "i", "j"), all_.repartition("band", "i", "j")
    met = few.join(all_, ["band", "i", "j"]).where("ca <> cb AND (cb = most OR a < b)")
    if "sig" in found.columns:
        met = met.where(agreed(F.col("oa.sig"), F.col("ob.sig")) >= AGREE)
    met = met.where(possible(F.col("oa.marks"), F.col("oa.n"), F.col("ob.marks"), F.col("ob.n"), similarity))
    # A function over an array keeps the join out of whole-stage code, where its condition would be one long method (slower, measured).
    met = met.where(~F.exists("oa.bands", lambda x: (x < F.col("band")) & F.array_contains("ob.bands", x)))
    # |A and B| / |A or B| >= s says |A and B| >= s / (1 + s) * (|A| + |B|), with the intersection named once.
    least = (similarity - MARGIN) / (1 + similarity - MARGIN)
    near = met.where(F.size(F.array_intersect("oa.set", "ob.set")) >= F.lit(least) * (F.size("oa.set") + F.size("ob.set")))
    out = stored(near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), "open-pairs")
    for made in (named, sized, texts, sets):
        discard(made)
    return out


def similar_lines(lines: DataFrame, found: DataFrame, similarity: float = 0.8) -> DataFrame:
    """(a, b): keys of different lines whose windows' Jaccard similarity is at
    least `similarity`; their components are those of all pairs that share a
    band (and agree in AGREE minima, where found has them)."""
    banded = found.select("key", F.explode("bands").alias("band"))
    groups = stored(banded.groupBy("band").agg(F.min("key").alias("lo"), F.max("key").alias("hi"), F.count("*").alias("n")).where("lo < hi"), "bands")
    members = stored(marked(banded, "band", bitmap(groups, "band")).where("__hit").drop("__hit").join(groups, "band"), "members")
    pairs = members.select("key", F.explode(F.array("lo", "hi")).alias("other")).where("key <> other")
    pairs = stored(pairs.select(F.least("key", "other").alias("a"), F.greatest("key", "other").alias("b")).distinct(), "pairs")
    probable = _probable(pairs, found, "star-pairs")
    texts = _texts(probable, lines)
    star = stored(alike(probable, texts, similarity), "star")
    for made in (pairs, probable, texts):
        discard(made)
    rest = open_pairs(members, connected_components(star), lines, found, similarity)
    texts = _texts(rest, lines)
    more = stored(alike(rest, texts, similarity), "open-alike")
    for made in (groups, members, rest, texts):
        discard(made)
    return star.unionByName(more)


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()


def _probable(pairs: DataFrame, found: DataFrame, name: str) -> DataFrame:
    if "sig" not in found.columns:
        return pairs
    return stored(likely(pairs, marked(found.select("key", "sig"), "key", bitmap(_ends(pairs), "key")).where("__hit").drop("__hit")), name)


def _texts(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """The lines that pairs name, each once."""
    named = marked(lines.select("key", "line"), "key", bitmap(_ends(pairs), "key")).where("__hit")
    return stored(named.groupBy("key").agg(F.min("line").alias("line")), "texts")


def line_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = 0.8) -> DataFrame:
    """docs with text less its repeated lines, and __lines and __dropped: lines
    with a word, and those of them that left."""
    lines = stored(lines_of(docs, doc_id, text), "lines")
    signed = stored(signatures(lines), "signatures")
    similar = similar_lines(lines, signed.where("sig IS NOT NULL").select("key", "sig", bands_of(F.col("sig")).alias("bands")), similarity)
    linked = stored(connected_components(similar).withColumnRenamed("node", "key"), "components")
    again = stored(signed.where("many").select("key").unionByName(linked.select("key")).distinct(), "again")
    places = stored(marked(lines.select("key", "key2", "doc", "rid", "pos"), "key", bitmap(again, "key")).where("__hit").drop("__hit"), "places")
    discard(lines)
    found = stored(places_of(places), "firsts")
    joined = stored(linked.join(found.select("key", "key2", "first"), "key"), "linked")
    firsts = joined.groupBy("component").agg(F.min("first").alias("keeper"))
    keepers = joined.select("key", "key2", "component").join(firsts, "component").select("key", "key2", "keeper")
    alone = found.where("n > 1").join(keepers.select("key", "key2"), ["key", "key2"], "left_anti").select("key", "key2", F.col("first").alias("keeper"))
    repeated = stored(keepers.unionByName(alone), "repeated")
    stays = F.struct("doc", "rid", "pos").eqNullSafe(F.col("keeper"))
    hits = stored(places.join(repeated, ["key", "key2"]).select("doc", "rid", "pos", stays.alias("stays")), "hits")
    # Rows that are equal in id and text have places in common: a place seen twice marks them.
    counted = hits.groupBy("doc", "rid", "pos").agg(F.count("*").alias("n"), F.max("stays").alias("stays")).where("n > 1 OR NOT stays")
    out = counted.groupBy("doc", "rid").agg(F.collect_list(F.when(~F.col("stays"), F.col("pos"))).alias("__drop"), F.max(F.col("n") > 1).alias("__again"))
    out = stored(out.select(F.col("doc").alias("__doc2"), F.col("rid").alias("__rid2"), "__drop", "__again"), "dropped")
    for made in (signed, linked, again, places, found, joined, repeated, hits):
        discard(made)

    names = docs.columns
    own = [F.col(f"`{c}`") for c in names]
    worded = lambda parts: F.coalesce(F.size(F.filter(parts, lambda x: x.rlike(r"[^\x20\x09-\x0D]"))), F.lit(0))
    rows = marked(docs.withColumn("__rid", row_key(doc_id, text)), "__rid", bitmap(out, "__rid2"))
    # One match a line with a word: from its first character of a word to its end.
    lines_in = F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(r"[^\x20\x09-\x0D][^\n]*")), F.lit(0))
    untouched = rows.where(~F.col("__hit")).select(*own, lines_in.alias("__lines"), F.lit(0).alias("__dropped"))
    touched = rows.where("__hit").join(out, (F.col("__rid") == F.col("__rid2")) & F.col(f"`{doc_id}`").eqNullSafe(F.col("__doc2")), "left").drop("__rid2", "__doc2")
    again = F.coalesce("__again", F.lit(False))
    once = touched.where(~again).withColumn("__later", F.lit(False))
    # Rows that are equal in id and text: the one with the least number keeps what stays. Numbers are stored, so they are no others when a part is computed again.
    more = stored(touched.where(again).withColumn("__n", F.monotonically_increasing_id()), "repeated-rows")
    first = more.groupBy(F.col(f"`{doc_id}`").alias("__d"), "__rid").agg(F.min("__n").alias("__n")).select("__n", F.lit(True).alias("__first"))
    more = more.join(first, "__n", "left").withColumn("__later", F.col("__first").isNull())
    both = once.unionByName(more.select(*once.columns)).withColumn("__body", F.split(F.col(f"`{text}`"), "\n", -1))
    # A later copy of a row keeps only its lines without a word.
    left = F.filter("__body", lambda x, i: F.when(F.col("__later"), ~x.rlike(r"[^\x20\x09-\x0D]")).otherwise(~F.array_contains(F.coalesce("__drop", F.array().cast("array<int>")), i)))
    both = both.withColumn("__left", left)
    fresh = [F.array_join("__left", "\n").alias(c) if c == text else F.col(f"`{c}`") for c in names]
    fixed = both.select(*fresh, worded(F.col("__body")).alias("__lines"), (worded(F.col("__body")) - worded(F.col("__left"))).alias("__dropped"))
    return untouched.unionByName(fixed)


def op3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = line_dedup(docs)
    return found.select("doc_id", "text", F.col("__lines").cast("bigint").alias("n_lines"), F.col("__dropped").cast("bigint").alias("n_dropped"))
