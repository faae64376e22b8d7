"""Operator 4, fuzzy line dedup in DataFrame operations: rare word pairs, SimHash order, edit similarity, connected groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinelake.llm.common import drop_path, materialize
from cinelake.llm.components import components

#: Words that vote on the bits of a block. Four bits count up to seven votes, and the third of them says which side has most.
VOTES = 7
_EACH = 0x1111111111111111
#: Sketches of a line, 64 bits each: a bit is set if one of its words is dealt there.
SKETCHES = [f"s{i}" for i in range(4)]
#: Least edit similarity: 1 - what is to be inserted, deleted or replaced / the longer line, counted in words, or in characters if the shorter line has less than SHORT.
SIMILARITY = 0.8
SHORT = 60
#: Word pairs at most under which a line looks for others.
KEYS = 12
#: The same of short lines, whose common pairs would bring too many lines together that no sketch tells apart.
SHORT_KEYS = 4
#: Lines of a key that all others of it are compared with before all pairs are made.
HUBS = 16
#: Bits of the number of a bitmap's cell of 64: a bitmap has a million cells at most, and is broadcast.
CELL_BITS = 20
#: Characters that stand for words when edits are counted, from FIRST_CODE on: two different words share one once in so many pairs.
CODES, FIRST_CODE = 1 << 20, 0x10000
#: Letters of short lines that are counted up to so many in two longs of a bit a count: common ones further than others.
LETTERS = {"n0": (8, "eaionrst"), "n1": (3, "uldcmpghbvfkwyzjqx,.-")}
#: What is told of a line when edits are counted.
TEXTS = ["words", "chars", *LETTERS]
#: Letters of scripts that are written without spaces: each is a word.
UNSPACED = r"([\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}])"


def normalised(line: Column) -> Column:
    """The line in lower case without spaces at its ends."""
    return F.trim(F.lower(line))


def words_of(norm: Column) -> Column:
    """The words of a normalised line."""
    apart = F.regexp_replace(F.trim(F.regexp_replace(norm, UNSPACED, " $1 ")), " +", " ")
    return F.split(F.when(F.octet_length(norm) > 1.5 * F.length(norm), apart).otherwise(norm), " ")


def _votes(hashes: Column, again: Column, n: Column) -> Column:
    """The VOTES longs that vote on a line's fingerprint, from two sorted arrays of n hashes of its words; null without words.

    The words that vote on a block are those of the least or greatest hashes of either array, a
    sample that depends on each word alone: an edited word leaves most blocks as they are. Fewer
    than VOTES words vote in turn. Votes are counted for all bits at once, four bits each.
    """
    low = lambda c: c.bitwiseAND(F.lit(0xFFFF))
    votes = []
    for j in range(VOTES):
        up, down = (F.lit(j) % n + 1).cast("int"), (F.lit(-1) - F.lit(j) % n).cast("int")
        samples = [low(F.element_at(a, at)) for a in (hashes, again) for at in (up, down)]
        vote = samples[0]
        for i, s in enumerate(samples[1:], 1):
            vote = vote.bitwiseOR(F.shiftleft(s, 16 * i))
        votes.append(vote)
    return F.when(n > 0, F.array(*votes))


def majority(votes: Column) -> Column:
    """The bits that most of the VOTES longs have."""
    out = F.lit(0).cast("long")
    for i in range(4):
        count = sum((F.shiftright(votes[j], i).bitwiseAND(F.lit(_EACH)) for j in range(1, VOTES)), F.shiftright(votes[0], i).bitwiseAND(F.lit(_EACH)))
        out = out.bitwiseOR(F.shiftleft(F.shiftright(count, 2).bitwiseAND(F.lit(_EACH)), i))
    return out


def with_fingerprint(df: DataFrame) -> DataFrame:
    """Adds `fp`, the SimHash of the words in column `w`."""
    hashed = df.withColumn("h", F.transform("w", lambda v: F.xxhash64(v)))
    ordered = hashed.withColumn("g", F.sort_array(F.transform("h", lambda v: F.xxhash64(v)))).withColumn("h", F.sort_array("h"))
    return ordered.withColumn("votes", _votes(F.col("h"), F.col("g"), F.size("h"))).withColumn("fp", majority(F.col("votes"))).drop("h", "g", "votes")


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    lines = docs.select(F.col(id_col).cast("long").alias("id"), F.posexplode(F.split(F.col(text_col).cast("string"), "\n")).alias("pos", "line"))
    return lines.select("id", "pos", normalised(F.col("line")).alias("norm"))


def _identity() -> tuple[Column, Column]:
    return F.xxhash64("norm").alias("x"), F.xxhash64(F.lit(1), "norm").alias("y")


def line_occurrences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, pos, x, y, n_chars) for each line: x and y identify the normalised line."""
    return _lines(docs, id_col, text_col).select("id", "pos", *_identity(), F.length("norm").alias("n_chars"))


def distinct_lines(occurrences: DataFrame) -> DataFrame:
    """(x, y, node, copies) for each different line that isn't blank: node (id, pos) is its first occurrence."""
    return occurrences.filter("n_chars > 0").groupBy("x", "y").agg(F.min(F.struct("id", "pos")).alias("node"), F.count("*").alias("copies"))


def line_keys(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(x, n_chars, n_words, sketches, key0 and so on) for each different line that isn't blank: sketches of its words, and its keys.

    Keys are pairs of neighbouring words. Of the n words of either of two lines of the least
    similarity at most e = (1 - similarity) * n have no equal in the other, so at most 2e of the
    n - 1 pairs are lost. Lines of up to KEYS + 1 words have all their pairs as keys, so they meet
    all that are as similar. Longer ones deal their pairs into KEYS bins, short ones (of less than
    SHORT characters) into SHORT_KEYS, and take of each the pair with the longest first word (long
    words are rare): that two of them have none in common is unlikely (the README has figures), not
    impossible. A short line of one word has no key and must be equal.
    """
    texts = _lines(docs.select(F.lit(0).alias("id"), F.col(text_col).alias("text")), "id", "text").filter("norm != ''").select(F.xxhash64("norm").alias("x"), F.length("norm").alias("n_chars"), words_of(F.col("norm")).alias("w"))
    words = texts.select("x", "n_chars", F.size("w").alias("n_words"), "w", F.posexplode("w").alias("i", "v"))
    following = F.get(F.col("w"), F.col("i") + 1)
    pair = F.shiftrightunsigned(F.xxhash64("v", following), 9)
    # words of over 255 bytes come last
    key = F.when(F.col("i") + 1 < F.col("n_words"), F.shiftleft(F.bitwise_not(F.octet_length("v").cast("long")), 55).bitwiseOR(pair))
    hashed = words.select("x", "n_chars", "n_words", F.xxhash64("v").alias("h"), key.alias("key"), F.when(F.col("n_chars") < SHORT, (pair % SHORT_KEYS).cast("int")).when(F.col("n_words") <= KEYS + 1, F.col("i")).otherwise((pair % KEYS).cast("int")).alias("bin"))
    # shifts take the lower six bits
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright("h", 57).cast("int"))
    sketches = [F.bit_or(F.when(F.col("h").bitwiseAND(F.lit(3)) == k, bit).otherwise(F.lit(0).cast("long"))).alias(c) for k, c in enumerate(SKETCHES)]
    keys = [F.min(F.when(F.col("bin") == k, F.col("key"))).alias(f"key{k}") for k in range(KEYS)]
    return hashed.groupBy("x").agg(F.max("n_chars").alias("n_chars"), F.max("n_words").alias("n_words"), *sketches, *keys)


def key_rows(keyed: DataFrame) -> DataFrame:
    """(key, x, n_chars, n_words, sketches): a row for each key of a line that some other line has too."""
    rows = keyed.select("x", F.explode(F.array(*(f"key{i}" for i in range(KEYS)))).alias("key")).filter("key is not null")
    shared = rows.select("key", "x", F.count("*").over(Window.partitionBy("key")).alias("lines")).filter("lines > 1")
    told = ["n_chars", "n_words", *SKETCHES]
    return shared.join(keyed.select("x", *told), "x").select("key", "x", *told)


def _may_be_similar(similarity: float) -> Column:
    """Of rows a and b of a key: lengths and sketches allow it; no pair that is as similar fails.

    A bit that only one line's sketches have stands for at least one of its words without an equal
    in the other. Written such that nothing in it is about one side alone: filters on one side of a
    self-join would keep its two equal sides from being shuffled once.
    """
    least = lambda c: F.greatest(f"a.{c}", f"b.{c}") * F.lit(similarity) - 1e-9
    only = lambda a, b: F.expr(" + ".join(f"bit_count({a}.{c} & ~{b}.{c})" for c in SKETCHES))
    words = (F.least("a.n_words", "b.n_words") >= least("n_words")) & (F.col("a.n_words") - only("a", "b") >= least("n_words")) & (F.col("b.n_words") - only("b", "a") >= least("n_words"))
    return F.when(_short(), F.least("a.n_chars", "b.n_chars") >= least("n_chars")).otherwise(words)


def _short() -> Column:
    return F.least("a.n_chars", "b.n_chars") < SHORT


def letter_counts(chars: Column, name: str) -> Column:
    """For each letter of LETTERS as many bits as it occurs, up to their number: bits that only one of two lines has are letters too many in it."""
    width, letters = LETTERS[name]
    out = F.lit(0).cast("long")
    for i, v in enumerate(letters):
        n = F.least(F.octet_length(chars) - F.octet_length(F.replace(chars, F.lit(v), F.lit(""))), F.lit(width))
        out = out.bitwiseOR(F.shiftleft(F.call_function("shiftleft", F.lit(1).cast("long"), n) - 1, width * i))
    return out


def _within(side: str, similarity: float, short: Column) -> Column:
    """Of two sides named by `side` ("{}.{}", say): the edit similarity is reached.

    Counting out takes the product of lengths, so what every edit distance is no less than comes
    first: letters that one short line has more often than the other, and words that the other
    line has nowhere (`translate` takes out those that it has).
    """
    at = lambda of, c: F.col(side.format(of, c))
    allowed = lambda c: F.floor(F.greatest(F.length(at("a", c)), F.length(at("b", c))) * F.lit(1 - similarity) + 1e-9).cast("int")
    counted = lambda c: F.call_function("levenshtein", at("a", c), at("b", c), allowed(c)) >= 0
    more = lambda a, b: sum((F.bit_count(at(a, c).bitwiseAND(F.bitwise_not(at(b, c)))) for c in LETTERS), F.lit(0))
    own = lambda a, b: F.length(F.call_function("translate", at(a, "words"), at(b, "words"), F.lit("")))
    chars = (more("a", "b") <= allowed("chars")) & (more("b", "a") <= allowed("chars")) & counted("chars")
    # the words of a are looked up in one table for all its partners
    words = (own("b", "a") <= allowed("words")) & (own("a", "b") <= allowed("words")) & counted("words")
    return F.when(short, chars).otherwise(words)


def _is_similar(similarity: float, once: bool = True) -> Column:
    """Of rows a and b with their texts: the edit similarity is reached.

    Only pairs that `_may_be_similar` lets pass are counted out, and with `once` only under the
    least of the keys that both have: lines that are nearly similar share many, and would be counted out, in
    vain, under each.
    """
    here = F.array_min(F.array_intersect("a.keys", "b.keys")) == F.col("a.key")
    return F.when(_may_be_similar(similarity), F.when(here if once else F.lit(True), _within("{}.{}", similarity, _short())).otherwise(False)).otherwise(False)


def met_rows(rows: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of which some other line under the same key may be similar: no pairs are made."""
    return rows.alias("a").join(rows.alias("b"), (F.col("a.key") == F.col("b.key")) & (F.col("a.x") != F.col("b.x")) & _may_be_similar(similarity), "left_semi")


def neighbour_pairs(rows: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b): each row and the one before it under its key, by fingerprint: as many pairs as rows at most."""
    by = Window.partitionBy("key").orderBy("fp", "n_words", "x")
    before = lambda c: F.lag(c).over(by)
    side = lambda of: F.struct(*(of(c).alias(c) for c in ("x", "n_words", "n_chars", *SKETCHES)))
    pairs = rows.select(side(F.col).alias("a"), side(before).alias("b"))
    return pairs.filter((F.col("a.x") != F.col("b.x")) & _may_be_similar(similarity)).select(F.greatest("a.x", "b.x").alias("a"), F.least("a.x", "b.x").alias("b")).distinct()


def hub_links(rows: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b): links between rows under a key and HUBS of them, chosen by hash, of different groups (`part`): HUBS times the rows are compared at most."""
    by = Window.partitionBy("key").orderBy(F.xxhash64("x"), "x")
    hubs = rows.withColumn("turn", F.row_number().over(by)).filter(F.col("turn") <= HUBS).drop("turn")
    on = (F.col("a.key") == F.col("b.key")) & (F.col("a.part") != F.col("b.part")) & _is_similar(similarity, once=False)
    return rows.alias("a").join(hubs.alias("b"), on).select(F.greatest("a.x", "b.x").alias("a"), F.least("a.x", "b.x").alias("b")).distinct()


def links_between(rows: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b): links between rows under a key, of different groups (`part`) only. What isn't similar is never a row."""
    on = (F.col("a.key") == F.col("b.key")) & (F.col("a.part") != F.col("b.part")) & (F.col("a.x") < F.col("b.x")) & _is_similar(similarity)
    return rows.alias("a").join(rows.alias("b"), on).select(F.col("a.x").alias("a"), F.col("b.x").alias("b")).distinct()


def coded_lines(docs: DataFrame, lines: DataFrame, wanted: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text", made: list[str] | None = None) -> DataFrame:
    """(x, n_chars, fp, words, chars, letter counts): of each wanted line a character a word, so that the built-in edit distance counts words, and its own characters if they may count.

    A bitmap of fixed size tells which lines may be wanted before any text is shuffled. `made` gets the path of a table that the result reads.
    """
    places, places_path = materialize(lines.join(wanted, "x", "left_semi").select("x", "node.id", "node.pos").dropDuplicates(["x"]), "places")
    if made is not None:
        made.append(places_path)
    hashed = F.xxhash64("id", "pos")
    cell, bit = F.shiftrightunsigned(hashed, 64 - CELL_BITS).alias("cell"), F.call_function("shiftleft", F.lit(1).cast("long"), hashed.bitwiseAND(F.lit(63)).cast("int")).alias("bit")
    bitmap = places.select(cell, bit).groupBy("cell").agg(F.bit_or("bit").alias("bits"))
    scanned = docs.select(F.col(id_col).cast("long").alias("id"), F.posexplode(F.split(F.col(text_col).cast("string"), "\n")).alias("pos", "line")).select("id", "pos", "line", cell, bit)
    maybe = scanned.join(F.broadcast(bitmap), "cell").filter(F.col("bits").bitwiseAND(F.col("bit")) != 0).select("id", "pos", normalised(F.col("line")).alias("norm"))
    texts = maybe.join(places, ["id", "pos"]).filter(F.xxhash64("norm") == F.col("x")).withColumn("w", words_of(F.col("norm")))
    coded = lambda w: F.lpad(F.hex(F.pmod(F.xxhash64(w), F.lit(CODES)) + FIRST_CODE), 8, "0")
    words = F.decode(F.unhex(F.array_join(F.transform("w", coded), "")), "UTF-32")
    chars = F.when(F.length("norm") * F.lit(similarity) <= SHORT, F.col("norm"))
    # documents that repeat an id have the line at the same place, or not at all
    return with_fingerprint(texts).select("x", F.length("norm").alias("n_chars"), "fp", words.alias("words"), chars.alias("chars"), *(letter_counts(chars, c).alias(c) for c in LETTERS)).dropDuplicates(["x"])


def verified(pairs: DataFrame, texts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs whose edit similarity is at least `similarity`."""
    side = lambda name: texts.select(F.col("x").alias(name), *(F.col(c).alias(f"{name}_{c}") for c in ("n_chars", *TEXTS)))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.filter(_within("{}_{}", similarity, F.least("a_n_chars", "b_n_chars") < SHORT)).select("a", "b")


def linked_lines(docs: DataFrame, lines: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(node, component) over the keys x of lines that are linked to another.

    Neighbours under a key are verified first, then each line with a few others of its key, which
    connects most of a large group of near copies with a few pairs for each line. Only then all
    are compared, under keys whose lines are not all connected, between lines that are not: no
    link between different groups is lost, and none within a group is made.
    """
    own, own_path = materialize(line_keys(docs, text_col), "keys")
    keyed, keyed_path = materialize(key_rows(own), "keyed")
    drop_path(docs.sparkSession, own_path)
    met, met_path = materialize(met_rows(keyed, similarity), "met")
    drop_path(docs.sparkSession, keyed_path)
    texts, texts_path = materialize(coded_lines(docs, lines, met.select("x").distinct(), similarity, id_col, text_col, made := []), "lines")
    near, near_path = materialize(components(verified(neighbour_pairs(met.join(texts.select("x", "fp"), "x"), similarity), texts, similarity)), "near")
    made.append(near_path)
    nearer, nearer_path = materialize(_more_links(near, hub_links(_apart(met, near, texts, made), similarity)), "near")
    while made:
        drop_path(docs.sparkSession, made.pop())
    linked = _more_links(nearer, links_between(_apart(met, nearer, texts, made), similarity))
    for path in (met_path, texts_path, nearer_path, *made):
        drop_path(docs.sparkSession, path)
    return linked


def _more_links(near: DataFrame, links: DataFrame) -> DataFrame:
    """Components of those found so far and of more links."""
    return components(near.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(links))


def _apart(met: DataFrame, near: DataFrame, texts: DataFrame, made: list[str] | None = None) -> DataFrame:
    """The rows with their group (`part`), texts and all such keys of their line (`keys`), under keys whose lines are not all of one. `made` gets the path of their table."""
    parted, parted_path = materialize(met.join(near.withColumnRenamed("node", "x"), "x", "left").withColumn("part", F.coalesce("component", "x")).drop("component"), "parted")
    open_keys = parted.groupBy("key").agg(F.min("part").alias("least"), F.max("part").alias("most")).filter("least != most").select("key")
    rows = parted.join(open_keys, "key", "left_semi")
    # a line has KEYS of them at most; lines of different groups share no key that is not open
    keys = rows.groupBy("x").agg(F.collect_list("key").alias("keys"))
    still, still_path = materialize(rows.join(texts.select("x", *TEXTS).join(keys, "x"), "x"), "open")
    drop_path(met.sparkSession, parted_path)
    if made is not None:
        made.append(still_path)
    return still


def repeated_lines(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_lines, places): per document with text its lines and the places of those that repeat, exactly or nearly, a line before them (by id, then place)."""
    if not 0.7 <= similarity <= 1:
        raise ValueError("the keys are made for similarities of 0.7 and more")
    seen, _ = materialize(line_occurrences(docs, id_col, text_col).filter("id is not null"), "occurrences")
    lines, lines_path = materialize(distinct_lines(seen), "distinct")
    linked, linked_path = materialize(linked_lines(docs, lines, similarity, id_col, text_col), "linked")
    grouped, grouped_path = materialize(lines.join(linked.withColumnRenamed("node", "member"), F.col("x") == F.col("member")).select("x", "y", "node", "component"), "grouped")
    first = grouped.groupBy("component").agg(F.min("node").alias("kept"))
    # what may go: copies of a line that occurs again, and all of a group's
    near = grouped.join(first, "component").select("x", "y", "kept")
    same = lines.filter("copies > 1").join(linked.select(F.col("node").alias("x")), "x", "left_anti").select("x", "y", F.col("node").alias("kept"))
    kept, _ = materialize(near.unionByName(same), "kept")
    for path in (lines_path, linked_path, grouped_path):
        drop_path(docs.sparkSession, path)
    goes = seen.select("id", "pos", "x", "y").join(kept, ["x", "y"]).filter("id != kept.id or pos != kept.pos").groupBy("id").agg(F.array_sort(F.collect_set("pos")).alias("places"))
    return seen.groupBy("id").agg((F.max("pos") + 1).alias("n_lines")).join(goes.join(ambiguous_ids(docs, id_col, text_col), "id", "left_anti"), "id", "left")


def ambiguous_ids(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id) of ids that rows of different texts have: a place says nothing about which of them has the line."""
    told = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("h"))
    return told.groupBy("id").agg(F.min("h").alias("least"), F.max("h").alias("most")).filter("least != most").select("id")


def line_report(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_lines, n_dropped, dropped) for each row, as dedup_lines() has them, without moving any text."""
    found = repeated_lines(docs, similarity, id_col, text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).isNull().alias("empty"))
    return rows.join(found, rows.doc_id == found.id, "left").select(
        "doc_id", F.when(F.col("empty"), 0).otherwise(F.col("n_lines")).alias("n_lines"), F.coalesce(F.size("places"), F.lit(0)).alias("n_dropped"), F.coalesce("places", F.array().cast("array<int>")).alias("dropped")
    )


def dedup_lines(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all columns, with repeated lines taken out of the text, and n_lines, n_dropped and dropped (their places) added.

    A line is normalised to lower case. Lines are equal if these are, and near if they meet under a
    key and their edit similarity reaches `similarity`, counted in words, or in characters where
    the shorter line has less than SHORT. Of each group that these links connect over all documents
    the first line, by id and place, stays. Blank lines stay. Null texts and rows with a null id
    are unchanged; rows that repeat an id and its text have the same places dropped, rows of one id
    with different texts keep all their lines, which others may still repeat. Clashing names:
    n_lines, n_dropped and dropped of docs are replaced; all other columns stay.
    """
    found = repeated_lines(docs, similarity, id_col, text_col).select(F.col("id").alias("__id"), F.col("n_lines").alias("__n_lines"), F.col("places").alias("__places"))
    joined = docs.drop("n_lines", "n_dropped", "dropped").join(found, F.col(id_col).cast("long") == F.col("__id"), "left").drop("__id")
    lines = F.transform(F.split(F.col(text_col).cast("string"), "\n"), lambda x, i: F.struct(x.alias("line"), i.alias("i")))
    kept = F.array_join(F.filter(lines, lambda s: ~F.array_contains("__places", s["i"]))["line"], "\n")
    return (
        joined.withColumn("n_lines", F.when(F.col(text_col).isNull(), 0).otherwise(F.col("__n_lines")))
        .withColumn("n_dropped", F.coalesce(F.size("__places"), F.lit(0)))
        .withColumn("dropped", F.coalesce("__places", F.array().cast("array<int>")))
        .withColumn(text_col, F.when(F.col("__places").isNull(), F.col(text_col)).otherwise(kept))
        .drop("__places", "__n_lines")
    )
