"""Document fingerprints by spot signatures, as DataFrame expressions.

A spot signature starts at an anchor, a very common word, and goes on with a chain of the next ``CHAIN`` content words (all
words but anchors, which are passed over). A fingerprint is the set of a text's signatures, as sorted hashes of 32 bits. Common
words stand everywhere in running prose, so most of a text lies in some chain; menus and lists have few (Theobald et al. 2008).

Words are runs of letters and digits of the text in lower case. A text without any signature has one for all its words, so equal
texts always have equal fingerprints, and no fingerprint is empty. The likeness of two is the Jaccard coefficient of the sets.

Neighbours in the order of doc_id are found in blocks of rows, so that no task orders the whole table.

:func:`similar_classes` finds all pairs of fingerprints with a likeness of at least ``SIMILAR``. Texts with equal fingerprints are one class, so
copies make no pairs. Sets are dealt to partitions by length, each ``1 / SIMILAR`` times as long as the one before: similar sets lie in one
partition or in two next to each other. Inside, two sets meet if they share a signature among the first of each in the order of how often signatures occur,
rarest first; so many signatures are looked at that none above the bound is lost. A pair is dropped as soon as lengths and places of the shared
signature show that it cannot reach the bound, and only what is left is compared in full. How often signatures occur is counted over all
classes, by ``RARITY`` groups of hashes; that number bounds what the driver sees. The links between n different near copies are n * n / 2 rows, as
they are the result.

Cases: a null text is an empty one; empty and blank texts share a fingerprint; repeated rows and equal doc_ids stand next to each
other in the order of their texts; with one row, the next document is that row; null doc_ids come first; an empty table gives an
empty result; the input's other columns are ignored, whatever their names. Rows without a doc_id are in classes like others; a class of such
rows alone has no number, and its links name none. doc_ids must be integers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaytrail.llm.common import stored

CHAIN = 2
#: Likeness from which two fingerprints are linked, and groups of hashes in which signatures are counted.
SIMILAR, RARITY = 0.8, 1 << 14
#: Rows that one window puts in order, and the largest number of such blocks.
BLOCK_ROWS, MOST_BLOCKS = 2048, 1 << 14
_STEP = 64

# The anchors, very common words of four languages.
ANCHORS = ("a and are as be by for in is it not of on that the this to was with you "
           "das der die ein eine einen für ist mit nicht sich und von zu "
           "con de del el en es la las los no para por que se su un una y "
           "dans des du elle est et le les par pas pour qui sur une").split()


def _any_of(words: list[str]) -> str:
    """A pattern for the words, branched by first letter."""
    heads: dict[str, list[str]] = {}
    for w in sorted(set(words), key=lambda w: (-len(w), w)):
        heads.setdefault(w[0], []).append(w[1:])
    return "(?:" + "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in sorted(heads.items())) + ")"


_ANCHOR = _any_of(ANCHORS)
_CHAINS = f"(?:^| )(?=({_ANCHOR}{f' (?:{_ANCHOR} )*+[^ ]+' * CHAIN}(?= )))"
_PASSED = f"(?<= ){_ANCHOR} "


def plain_words(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def signatures(text: Column) -> Column:
    """The sorted set of signature hashes of a text."""
    words = plain_words(text)
    chains = F.regexp_extract_all(F.concat(words, F.lit(" ")), F.lit(_CHAINS), 1)
    # an anchor inside a chain is passed over, so it is no part of the signature
    found = F.transform(chains, lambda c: F.hash(F.regexp_replace(c, _PASSED, "")))
    return F.sort_array(F.array_distinct(F.when(F.size(chains) > 0, found).otherwise(F.array(F.hash(words)))))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard coefficient of two sets."""
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


# Neighbours in the order of doc_id

def _blocks(docs: DataFrame, block_rows: int) -> list[int]:
    """doc_ids at which a new block begins: at most MOST_BLOCKS quantiles, values that occur, above the smallest."""
    rows = docs.select("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("least")).first()
    n = min(MOST_BLOCKS, rows.n // block_rows)
    if n < 1 or rows.least is None:
        return []
    at = docs.agg(F.percentile_approx("doc_id", [(k + 1) / (n + 1) for k in range(n)], max(10_000, 4 * n)).alias("q")).first().q
    return sorted({int(q) for q in at} - {rows.least})


def _block_of(doc_id: Column, begins: list[int]) -> Column:
    """Number of entries of ``begins`` up to a doc_id, in two steps of about the same size."""
    if not begins:
        return F.lit(0)
    upto = lambda array: F.size(F.filter(array, lambda b: b <= doc_id))
    head = upto(F.lit(begins[::_STEP]))
    base = (head - 1) * _STEP
    return F.when(doc_id.isNull() | (doc_id < begins[0]), 0).otherwise(base + upto(F.slice(F.lit(begins), base + 1, _STEP)))


def with_next(docs: DataFrame, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, Window]:
    """(doc_id, _text, _next and _real of every row, the window in which they stand).

    Rows are put in order inside blocks of doc_ids. The first row of each block is also added, as not real, to the end of the
    block before (that of the first block to the last one), so every real row has its successor in its own block.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text"))
    begins = _blocks(rows, block_rows)
    blocks = len(begins) + 1
    least = rows.agg(F.count(F.lit(1)).alias("n"), F.count("doc_id").alias("known"), F.min("doc_id").alias("least")).first()
    first_id = F.col("doc_id").isNull() if least.known < least.n else F.col("doc_id") == F.lit(least.least)
    firsts = (rows.filter(first_id | F.col("doc_id").isin(begins) if begins else first_id)
              .withColumn("_block", _block_of(F.col("doc_id"), begins))
              .groupBy("_block").agg(F.min(F.struct(F.xxhash64("_text").alias("h"), F.col("_text"))).alias("f")))
    ends = firsts.select(F.lit(None).cast(docs.schema["doc_id"].dataType).alias("doc_id"), F.col("f._text").alias("_text"), F.lit(False).alias("_real"),
                         F.pmod(F.col("_block") - 1, F.lit(blocks)).cast("int").alias("_block"))
    every = rows.select("doc_id", "_text", F.lit(True).alias("_real"), _block_of(F.col("doc_id"), begins).cast("int").alias("_block")).union(ends)
    order = Window.partitionBy("_block").orderBy(F.desc("_real"), F.asc_nulls_first("doc_id"), F.xxhash64("_text"), "_text")
    return every.withColumn("_next", F.lead("_text").over(order)), order


def compare_neighbours(docs: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Of every row: doc_id, n_chars, _edited (its second half replaced by the start of the next text), the signature sets _own,
    _of_edited and _of_next."""
    rows, order = with_next(docs, block_rows)
    n = F.length("_text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("_text"), F.lit(1), n - half), F.substring(F.col("_next"), F.lit(1), half))
    return (rows.withColumn("_edited", F.when(F.col("_real"), edited))
            .withColumn("_own", signatures(F.col("_text")))
            .withColumn("_of_next", F.lead("_own").over(order))
            .filter("_real").withColumn("_of_edited", signatures(F.col("_edited")))
            .select("doc_id", n.cast("long").alias("n_chars"), "_edited", "_own", "_of_edited", "_of_next"))


# All similar fingerprints

def classes_of(docs: DataFrame) -> DataFrame:
    """doc_id, _own (signatures) and _class (128 bits of a hash of them) of every document."""
    rows = docs.select("doc_id", signatures(F.coalesce("text", F.lit(""))).alias("_own"))
    return rows.withColumn("_class", F.struct(F.xxhash64("_own").alias("a"), F.xxhash64(F.lit("class"), "_own").alias("b")))


def _candidates(classes: DataFrame, similar: float) -> DataFrame:
    """Pairs (_x, _y) of classes that may be similar; _x has no more signatures than _y."""
    group = lambda c: F.pmod(F.xxhash64(c), F.lit(RARITY)).cast("int")
    counted = classes.select(F.explode("_own").alias("s")).groupBy(group(F.col("s")).alias("g")).agg(F.count(F.lit(1)).alias("n")).collect()
    often = [0] * RARITY
    for r in counted:
        often[r.g] = r.n
    common = F.lit(often)
    order = F.sort_array(F.transform("_own", lambda s: F.struct(common[group(s)].alias("n"), s.alias("s"))))
    n = F.size("_own")
    prefix = n - F.ceil(n * similar - 1e-9).cast("int") + 1
    heads = classes.select("_class", n.alias("_n"), F.floor(F.log(n.cast("double")) / F.log(F.lit(1 / similar)) + 1e-9).cast("int").alias("_part"),
                           F.posexplode(F.slice(F.transform(order, lambda x: x["s"]), F.lit(1), prefix)).alias("_at", "_s"))
    left = heads.select(F.col("_class").alias("_x"), F.col("_n").alias("_nx"), F.col("_at").alias("_ax"), "_s",
                        F.explode(F.array(F.col("_part"), F.col("_part") + 1)).alias("_part"))
    right = heads.select(F.col("_class").alias("_y"), F.col("_n").alias("_ny"), F.col("_at").alias("_ay"), "_s", "_part")
    pairs = left.join(right, ["_s", "_part"]).filter((F.col("_nx") < F.col("_ny")) | ((F.col("_nx") == F.col("_ny")) & (F.col("_x") < F.col("_y"))))
    most = F.least(F.col("_nx") - F.col("_ax"), F.col("_ny") - F.col("_ay")) + F.least("_ax", "_ay")   # signatures both can still share
    return pairs.filter((F.col("_nx") >= F.col("_ny") * similar - 1e-9) & (most >= (F.col("_nx") + F.col("_ny")) * (similar / (1 + similar)) - 1e-9)
                        ).select("_x", "_y").distinct()


def similar_classes(docs: DataFrame, similar: float = SIMILAR) -> tuple[DataFrame, DataFrame]:
    """(doc_id and class_id of every document, class_a, class_b and likeness of every two similar classes).

    A class is named by its smallest doc_id. Equal fingerprints are one class; classes of a pair are named in the order of their numbers."""
    rows = stored(classes_of(docs), "spot-sets")
    classes = stored(rows.groupBy("_class").agg(F.min("doc_id").alias("class_id"), F.first("_own").alias("_own")), "spot-classes")
    named = lambda c: classes.select(F.col("_class").alias(c), F.col("class_id").alias(f"{c}_id"), F.col("_own").alias(f"{c}_own"))
    pairs = _candidates(classes, similar).join(named("_x"), "_x").join(named("_y"), "_y").withColumn("likeness", likeness(F.col("_x_own"), F.col("_y_own")))
    links = pairs.filter(F.col("likeness") >= similar - 1e-12).select(
        F.least("_x_id", "_y_id").alias("class_a"), F.greatest("_x_id", "_y_id").alias("class_b"), "likeness")
    return rows.join(classes.select("_class", "class_id"), "_class").select("doc_id", "class_id"), links


def similar_documents(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """doc_id, class_id and links (other classes that are similar) of every document."""
    members, links = similar_classes(docs, similar)
    ends = links.select(F.explode(F.array("class_a", "class_b")).alias("class_id")).groupBy("class_id").agg(F.count(F.lit(1)).alias("links"))
    return members.join(ends, members["class_id"].eqNullSafe(ends["class_id"]), "left").select(
        "doc_id", members["class_id"], F.coalesce("links", F.lit(0)).alias("links"))
