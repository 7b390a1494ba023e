"""Line dedup by a deletion-neighbourhood join, in DataFrame functions alone.

Lines of `min_words` words or more are compared. Equal lines form one different line, first seen at the
smallest (document, line number). Different lines of `near_words` words or more also match within one
word inserted, deleted or replaced. For that each line emits its variants: without word i, and with
nothing taken out at gap i, keyed by (i, hash of the words before, hash of the words after), where
the hashes are XORs over (word, place from the near end). Two lines within the bound share a key. Within
a key every line is compared with the earliest one alone, so no pairs are spelled out, and a line goes if
an earlier one matches: exact for this rule, as all lines of a key lie within the bound of each other.
A match is verified on the words before it counts. With `near_chars`, shorter lines of that many
characters or more do the same with characters in place of words: one inserted, deleted or replaced. A line
of `near_words` words and one of a word less match then by the measure of either: within one word, or within one
character where both have `near_chars`. Two of the shorter ones may share a key of words without a match, so
here each line meets the earliest of the other number of words.

Only lines that could match emit variants: one edit leaves the first or the last half of the shorter
line intact, so a line whose halves (for its own length and one less) no other different line shares
is out. Those that are left are cut into PARTS, for their own length and for one more: one edit changes one part of
the longer line, so a line emits the variants of a part only where another line agrees in all the other parts.
Counting keys before variants keeps the shuffle to a few numbers per line.

Edge cases: null texts stay null and empty texts empty; blank lines and those under `min_words` are never dropped; equal
rows (same document and line number) count as one place, so both stay; a line repeated in one document
stays once; an empty table gives an empty result; extra columns are kept, except that n_lines, n_exact and n_near
replace those of the same name; rows without an id come first in the order and keep all their lines, which other rows' lines are held against.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalog.llm.common import beside, discard, documents, materialize

MIN_WORDS = 4
NEAR_WORDS = 10
#: The query compares equal lines from one word on, and lines under NEAR_WORDS within one character from this length on.
ALL_WORDS, NEAR_CHARS = 1, 20
#: Characters of a line under NEAR_WORDS up to which its variants are hashed as they are, which takes the square of its length;
#: from this length on running XORs over its characters do the same in linear time.
MOST_CHARS = 400
#: Words of a line up to which its variants are hashed as they are. Longer running XORs, over words or characters, are put together
#: from parts of that many.
CHUNK = 256
#: Parts of a line of which all but one have to agree with another line's before it emits that one's variants.
PARTS = 8
#: Keys of several lines up to which their table is broadcast (about 10 MB); beyond it the planner deals the join.
MOST_GROUPS = 200_000


def plain(docs: DataFrame, key: str, *more: str) -> DataFrame:
    """id, more, t: each text with single blanks for white space but line ends; its lines, trimmed, are the words parted by blanks."""
    text = blank = F.col("text")
    for c in "\t\v\f\r":
        blank = F.replace(blank, F.lit(c), F.lit(" "))
    # To look for a character costs a fraction of replacing it, even where there is none.
    odd = reduce(Column.__or__, [F.contains(text, F.lit(c)) for c in "\t\v\f\r"])
    t = docs.select(F.col(key).alias("id"), *more, F.when(odd, blank).otherwise(text).alias("t"))
    return t.select("id", *more, F.when(F.contains("t", F.lit("  ")), F.regexp_replace("t", " {2,}", " ")).otherwise(F.col("t")).alias("t"))


def n_words(norm: Column) -> Column:
    return F.when(norm == "", 0).otherwise(F.length(norm) - F.length(F.replace(norm, F.lit(" "), F.lit(""))) + 1)


def by_chars(n: Column, near_words: int, near_chars: int | None) -> Column:
    """Whether edits of a line of n words count in characters; in words otherwise."""
    return F.lit(False) if near_chars is None else n < near_words


def lines_of(docs: DataFrame, key: str) -> DataFrame:
    # To explode a column of arrays would make Spark filter by it and so split twice.
    return plain(docs, key).select("id", F.posexplode(F.split("t", "\n")).alias("pos", "line")).select("id", "pos", F.trim("line").alias("norm"))


def hashes() -> list[Column]:
    return [F.xxhash64("norm").alias("h1"), F.xxhash64(F.lit("second"), F.col("norm")).alias("h2")]


def keyed(docs: DataFrame, key: str, min_words: int, near_words: int, near_chars: int | None) -> DataFrame:
    """id, pos, h1, h2 (two hashes of the words) and halves (where near matches count) of each line that counts."""
    t = lines_of(docs, key)
    # The filter moves below the trimming: as a comparison it costs less there than a count.
    t = (t.where("norm != ''") if min_words == 1 else t).withColumn("n", n_words(F.col("norm")))
    t = t if min_words == 1 else t.where(F.col("n") >= min_words)
    near = F.when(F.col("n") >= near_words, halves_of_words())
    if near_chars is not None:
        # Lines at the border of the two measures have halves by both.
        none = F.array().cast("array<bigint>")
        in_words = F.when(F.col("n") >= near_words - 1, halves_of_words()).otherwise(none)
        in_chars = F.when((F.col("n") <= near_words) & (F.length("norm") >= near_chars), halves_of_chars()).otherwise(none)
        near = F.concat(in_words, in_chars)
    return t.select("id", "pos", *hashes(), near.alias("halves"))


def halves(n: Column, tag: str, first, last) -> Column:
    """Keys of the first and last half, for the line's own length and one less. first(count), last(count): units of the line."""
    # Of a length of 2 k these are the first k and k - 1 and the last k; of 2 k + 1 the first k and the last k and k + 1.
    k, odd = F.floor(n / 2).cast("int"), n % 2 == 1
    start, end = (lambda c: F.xxhash64(F.lit("first" + tag), first(c))), (lambda c: F.xxhash64(F.lit("last" + tag), last(c)))
    return F.array(start(k), end(k), F.when(odd, end(k + 1)).otherwise(start(k - 1)))


def first_chars(k: Column) -> Column:
    return F.substr("norm", F.lit(1), k)


def last_chars(k: Column) -> Column:
    return F.substr("norm", F.length("norm") - k + 1, k)


def halves_of_words() -> Column:
    ends = lambda k: F.call_function("substring_index", F.col("norm"), F.lit(" "), k)
    return halves(F.col("n"), "", ends, lambda k: ends(-k))


def halves_of_chars() -> Column:
    return halves(F.length("norm"), " chars", first_chars, last_chars)


def parts(lines: DataFrame, n: Column, tag: str, first, last) -> DataFrame:
    """h1, h2, part (hash of all of a line of n units but units lo to hi), lo, hi, gap: for its own length, and with a gap put in for one more."""
    at = lines.select("h1", "h2", "norm", n.alias("n"), F.explode(F.sequence(F.lit(0), F.lit(2 * PARTS - 1))).alias("j"))
    at = at.select("h1", "h2", "norm", (F.col("j") % PARTS).alias("j"), (F.col("j") >= PARTS).alias("gap"), (F.col("n") + F.floor(F.col("j") / PARTS)).alias("n"))
    end = lambda j: F.floor(F.col("n") * j / PARTS).cast("int")
    at = at.select("h1", "h2", "norm", "j", "gap", "n", end(F.col("j")).alias("lo"), end(F.col("j") + 1).alias("hi")).where("lo < hi")
    rest = F.xxhash64(F.lit("part" + tag), "n", "j", first(F.col("lo")), last((F.col("n") - F.col("hi")).cast("int")))
    return at.select("h1", "h2", rest.alias("part"), "lo", "hi", "gap")


def worded(lines: DataFrame) -> DataFrame:
    """lines with an array of words as norm: parts of it cost less than parts of the text that are words."""
    return lines.withColumn("norm", F.split("norm", " "))


def spotted(suspects: DataFrame, near_chars: int | None) -> DataFrame:
    """The suspects that agree with another one in all parts but one, and spots: from, to and kind (gap or not) of the variants that count."""
    words, chars = suspects.where("not chars"), suspects.where("chars").where(F.length("norm") >= (near_chars or 0))
    n = F.size("norm")
    cut = parts(worded(words), n, "", lambda k: F.slice("norm", F.lit(1), k), lambda k: F.slice("norm", n - k + 1, k))
    cut = materialize(cut.unionByName(parts(chars, F.length("norm"), " chars", first_chars, last_chars)), "parts")
    shared = cut.groupBy("part").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("part")
    spots = cut.join(shared, "part").groupBy("h1", "h2").agg(F.collect_list(F.struct("lo", "hi", "gap")).alias("spots"))
    found = materialize(suspects.join(spots, ["h1", "h2"]), "spots")
    discard(cut)
    return found


def everywhere(n: Column) -> Column:
    """spots of all variants of a line of n units."""
    spot = lambda hi, gap: F.struct(F.lit(0).alias("lo"), hi.alias("hi"), F.lit(gap).alias("gap"))
    return F.array(spot(n, False), spot(n + 1, True))


def places_of_spots() -> Column:
    """Array of i and gap: each place in the spots."""
    return F.flatten(F.transform("spots", lambda s: F.transform(F.sequence(s["lo"], s["hi"] - 1), lambda i: F.struct(i.alias("i"), s["gap"].alias("gap")))))


def running(hashes: Column) -> Column:
    """[0, h1, h1 ^ h2, ...]; each step copies what is there, so the time grows with the square."""
    return F.aggregate(hashes, F.array(F.lit(0).cast("long")), lambda a, x: F.concat(a, F.array(F.element_at(a, -1).bitwiseXOR(x))))


def running_of_many(t: DataFrame, *names: str) -> DataFrame:
    """t with running() of the array columns of these names, from parts of CHUNK."""
    # Each step is a column of its own that the next reads more than once, so that Spark doesn't work it out again per element.
    def parts(h: str) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(h) - 1) / CHUNK).cast("int")), lambda k: running(F.slice(h, k * CHUNK + 1, CHUNK)))

    def whole(h: str) -> Column:
        heads = F.slice(running(F.transform(h, lambda p: F.element_at(p, -1))), F.lit(1), F.size(h))
        return F.flatten(F.zip_with(heads, h, lambda x, p: F.transform(F.slice(p, 2, CHUNK), lambda y: y.bitwiseXOR(x))))

    t = t.withColumns({h: parts(h) for h in names})
    return t.withColumns({h: F.concat(F.array(F.lit(0).cast("long")), whole(h)) for h in names})


def variants(words: DataFrame, chars: DataFrame) -> DataFrame:
    """h1, h2, id, pos, key: the deletion neighbourhood of each line at its spots, by words and by characters."""
    size, n = F.length("norm"), n_words(F.col("norm"))
    # A line of CHUNK words or MOST_CHARS has both kinds of keys: those that shorter ones have, and those of longer ones.
    found = [of_few(worded(words.where(n <= CHUNK)), "words", lambda i: F.slice("norm", F.lit(1), i), lambda i: F.slice("norm", i + 1, F.size("norm")))]
    found += [of_few(chars.where(size <= MOST_CHARS), "chars", first_chars, lambda i: F.substr("norm", i + 1))]
    found += [of_many(words.where(n >= CHUNK), " "), of_many(chars.where(size >= MOST_CHARS), "")]
    return reduce(DataFrame.unionByName, found)


def of_few(suspects: DataFrame, tag: str, first, past) -> DataFrame:
    """Keys that hash the parts of a line as they are, which takes the square of its length. first(i), past(i): its first i units and those after."""
    cut = suspects.select("h1", "h2", "id", "pos", "norm", F.explode(places_of_spots()).alias("p"))
    i = F.col("p.i")
    key = F.xxhash64(F.lit(tag), i, first(i), past(i + F.when(F.col("p.gap"), 0).otherwise(1)))
    return cut.select("h1", "h2", "id", "pos", key.alias("key"))


def of_many(suspects: DataFrame, mark: str) -> DataFrame:
    """Keys by running XORs over the units that mark parts: words, or characters if it is empty."""
    split = suspects.select("h1", "h2", "id", "pos", "spots", F.split("norm", mark).alias("w"))
    kind = "" if mark else " chars"
    before = F.transform("w", lambda x, i: F.xxhash64(F.lit("b" + kind), i, x))
    after = F.transform("w", lambda x, i: F.xxhash64(F.lit("a" + kind), F.size("w") - i, x))
    sums = running_of_many(split.select("h1", "h2", "id", "pos", "spots", before.alias("b"), after.alias("a")), "b", "a")
    past = lambda p: F.get("a", p["i"] + F.when(p["gap"], 0).otherwise(1))
    key = lambda p: F.xxhash64(p["i"], F.get("b", p["i"]), F.element_at("a", -1).bitwiseXOR(past(p)))
    return sums.select("h1", "h2", "id", "pos", F.explode(F.transform(places_of_spots(), key)).alias("key"))


def within_one(x: Column, y: Column) -> Column:
    """Whether word arrays x and y differ by one word inserted, deleted or replaced (or not at all)."""
    same = F.aggregate(F.arrays_zip(x.alias("x"), y.alias("y")), F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda t, z: F.struct((t["n"] + F.when(t["on"] & z["x"].eqNullSafe(z["y"]), 1).otherwise(0)).alias("n"), (t["on"] & z["x"].eqNullSafe(z["y"])).alias("on")), lambda t: t["n"])
    rest = lambda c, k: F.slice(c, same + 1 + k, F.greatest(F.size(c), F.lit(1)))
    return (F.abs(F.size(x) - F.size(y)) <= 1) & F.when(F.size(x) == F.size(y), rest(x, 1) == rest(y, 1)).when(F.size(x) > F.size(y), rest(x, 1) == rest(y, 0)).otherwise(rest(x, 0) == rest(y, 1))


def across(suspects: DataFrame, near_words: int, near_chars: int) -> tuple[DataFrame, ...]:
    """h1, h2, g1, g2: lines of near_words words, or one less, and the earlier ones of the other number that share a key; tables to discard."""
    edge = suspects.withColumn("n", n_words(F.col("norm"))).where(F.col("n").between(near_words - 1, near_words))
    parts = edge.select("h1", "h2", "n", F.explode(F.concat(halves_of_words(), halves_of_chars())).alias("half"))
    shared = parts.groupBy("half").agg(F.min("n").alias("less"), F.max("n").alias("more")).where("less < more").select("half")
    edge = edge.join(parts.join(shared, "half").select("h1", "h2").distinct(), ["h1", "h2"], "left_semi")
    # The number of words goes with the place, after it in the order.
    edge = materialize(edge.withColumn("pos", F.struct("pos", "n")), "edge")
    chars = edge.where(F.length("norm") >= near_chars).withColumn("spots", everywhere(F.length("norm")))
    var = materialize(variants(edge.withColumn("spots", everywhere(F.col("n"))), chars), "border")
    place, less = F.struct("id", "pos", "h1", "h2"), F.col("pos.n") < near_words
    firsts = var.groupBy("key").agg(F.min(F.when(less, place)).alias("less"), F.min(F.when(~less, place)).alias("more")).where("less is not null and more is not null")
    met = var.join(firsts, "key").select("h1", "h2", place.alias("place"), F.when(less, F.col("more")).otherwise(F.col("less")).alias("first"))
    return met.where("first < place").select("h1", "h2", F.col("first.h1").alias("g1"), F.col("first.h2").alias("g2")), edge, var


def near_matches(docs: DataFrame, halves_of: DataFrame, key: str, near_words: int = NEAR_WORDS, near_chars: int | None = None) -> DataFrame:
    """h1, h2 of different lines for which an earlier line lies within the bound."""
    # Tables that are joined by key are written first: Spark then splits a hot one's rows over tasks.
    shared = materialize(halves_of.groupBy("half").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("half"), "halves")
    places = halves_of.join(shared, "half").select("h1", "h2", "id", "pos").distinct()
    # The suspects' words come from their documents: one row per document, not per line.
    wanted = places.groupBy("id").agg(F.collect_list(F.struct("pos", "h1", "h2")).alias("at"))
    # Only texts that are wanted are worked on, so the join comes first.
    found = docs.select(F.col(key).alias("id"), "text").join(wanted, "id")
    texts = plain(found, "id", "at").select("id", F.split("t", "\n").alias("ls"), "at").select("id", "ls", F.explode("at").alias("p"))
    w = texts.select("id", F.col("p.pos").alias("pos"), F.col("p.h1").alias("h1"), F.col("p.h2").alias("h2"), F.trim(F.coalesce(F.get("ls", F.col("p.pos")), F.lit(""))).alias("norm"))
    # Rows without an id meet in no join by it: their lines are found by their hashes.
    lost = halves_of.where("id is null")
    if not lost.isEmpty():
        bare = lines_of(docs.where(F.col(key).isNull()), key).select("id", "pos", *hashes(), "norm")
        w = w.unionByName(bare.join(lost.join(shared, "half").select("h1", "h2").distinct(), ["h1", "h2"], "left_semi").select(w.columns))
    full = w.select("id", "pos", "h1", "h2", by_chars(n_words(F.col("norm")), near_words, near_chars).alias("chars"), "norm")
    # Rows of one id and different texts: a line is only looked for where it is.
    suspects = materialize(full.where(F.xxhash64("norm") == F.col("h1")).dropDuplicates(["h1", "h2"]), "lines")
    close = spotted(suspects, near_chars)
    var = materialize(variants(close.where("not chars"), close.where("chars")), "variants")
    groups = materialize(var.groupBy("key").agg(F.min(F.struct("id", "pos", "h1", "h2")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "first"), "groups")
    few = groups.count() <= MOST_GROUPS
    links = var.join(F.broadcast(groups) if few else groups, "key").where((F.col("h1") != F.col("first.h1")) | (F.col("h2") != F.col("first.h2"))).select("h1", "h2", F.col("first.h1").alias("g1"), F.col("first.h2").alias("g2"))
    made = ()
    if near_chars is not None:
        more, *made = across(suspects, near_words, near_chars)
        links = links.unionByName(more)
    links = links.distinct()
    mine = suspects.select("h1", "h2", "chars", F.col("norm").alias("x"))
    theirs = suspects.select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), F.col("norm").alias("y"), F.col("chars").alias("c"))
    both = links.join(mine, ["h1", "h2"]).join(theirs, ["g1", "g2"])
    few, many = F.levenshtein("x", "y", 1) >= 0, within_one(F.split("x", ""), F.split("y", ""))
    in_chars = F.when(F.length("x") <= MOST_CHARS, few).otherwise(many)
    in_words = within_one(F.split("x", " "), F.split("y", " "))
    either = in_words | ((F.least(F.length("x"), F.length("y")) >= (near_chars or 0)) & in_chars)
    near = F.when(F.col("chars") != F.col("c"), either).when(F.col("chars"), in_chars).otherwise(in_words)
    found = materialize(both.where(near).select("h1", "h2").distinct(), "near")
    discard(shared, suspects, close, var, groups, *made)
    return found


def drops(docs: DataFrame, key: str = "doc_id", min_words: int = MIN_WORDS, near_words: int = NEAR_WORDS, near_chars: int | None = None) -> DataFrame:
    """id, pos, near: the lines that go, and whether for an edited earlier line."""
    narrow = materialize(keyed(docs, key, min_words, near_words, near_chars), "keys")
    firsts = narrow.groupBy("h1", "h2").agg(F.min(F.struct("id", "pos")).alias("first"), F.min("halves").alias("halves"), F.count(F.lit(1)).alias("n"))
    firsts = materialize(firsts, "firsts")
    halves_of = firsts.where("halves is not null").select("h1", "h2", F.col("first.id").alias("id"), F.col("first.pos").alias("pos"), F.explode("halves").alias("half"))
    near = near_matches(docs, halves_of, key, near_words, near_chars).withColumn("near", F.lit(True))
    # Lines seen once that nothing matches need no further look.
    decided = firsts.join(near, ["h1", "h2"], "left").where((F.col("n") > 1) | F.col("near")).select("h1", "h2", "first", F.coalesce("near", F.lit(False)).alias("near"))
    return narrow.select("id", "pos", "h1", "h2").join(decided, ["h1", "h2"]).where(F.col("near") | (F.struct("id", "pos") != F.col("first"))).select("id", "pos", "near")


def dedup_lines(docs: DataFrame, key: str = "doc_id", min_words: int = MIN_WORDS, near_words: int = NEAR_WORDS, near_chars: int | None = None) -> DataFrame:
    """docs with lines taken out of text, and n_lines, n_exact, n_near (dropped) added."""
    gone = drops(docs, key, min_words, near_words, near_chars).groupBy("id").agg(F.collect_set("pos").alias("__gone"), F.size(F.collect_set(F.when(~F.col("near"), F.col("pos")))).alias("__exact"))
    joined = docs.join(gone.withColumnRenamed("id", "__id"), F.col(key) == F.col("__id"), "left")
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("__gone", i)), "\n")
    others = [F.col(f"`{c}`") if c != "text" else F.when(F.col("__gone").isNull(), F.col("text")).otherwise(kept).alias("text") for c in beside(docs, "n_lines", "n_exact", "n_near")]
    count = F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long")
    return joined.select(*others, F.when(F.col("text").isNull(), 0).otherwise(count).cast("long").alias("n_lines"), F.coalesce("__exact", F.lit(0)).cast("long").alias("n_exact"), (F.coalesce(F.size("__gone"), F.lit(0)) - F.coalesce("__exact", F.lit(0))).cast("long").alias("n_near"))


def op6_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return dedup_lines(docs, min_words=ALL_WORDS, near_chars=NEAR_CHARS)
