"""I-Match fingerprints with several randomised lexicon subsets. DataFrame functions only.

Terms are counted by document; those within a band of document frequency form the
lexicon. A text's lexicon terms are made distinct and sorted, cut down to several
random subsets of the lexicon, and each subset's terms are hashed together. Subsets
are nested: of each of ``draws`` drawings, the one with half, a quarter, ... of the
lexicon, so that short and long texts both have subsets with few of their terms. A
fingerprint is the row of these hashes; two are alike in the share of subsets with
equal hashes among those in which either has terms.

Size of the lexicon: a term in the band is in at least ``least`` of all documents,
so there are at most (mean number of different terms of a document) / ``least`` of
them, 27,000 for 270 terms, however many documents there are. It is fetched and
becomes a set inside the expressions.

The document after another, by descending id, is found on ids alone: they are
dealt by range, ordered within ranges, and the ends of ranges are tied by a table of
one row per range. Texts are then moved once by id, and their beginnings once more.

Defined cases: a missing text is an empty one; a text without lexicon terms is
hashed by all its terms; texts without terms have the fingerprint of no terms and
are fully alike; of rows with the same id, the smallest text beginning stands for
the id as the next document; a missing id counts as one id after all others; with
one id, a document's next one is itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.session import materialize

#: drawings, and how often each is halved; a term's 64-bit hash has 8 bits for each drawing
DRAWS = 8
HALVINGS = range(1, 9)
#: shares of documents between which a term belongs to the lexicon
BAND = (0.01, 0.05)
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def terms_of(text: Column) -> Column:
    """Different words, A-Z made small."""
    return F.array_remove(F.array_distinct(F.split(F.translate(text, _CAPITALS, _CAPITALS.lower()), r"[\x20\x09-\x0D]+")), "")


def fit_lexicon(docs: DataFrame, text: str, band: tuple[float, float] = BAND) -> list[str]:
    """Terms in at least ``band[0]`` and at most ``band[1]`` of all documents."""
    n = docs.count()
    counts = docs.select(F.explode(terms_of(F.coalesce(F.col(text), F.lit("")))).alias("term")).groupBy("term").count()
    rows = counts.where(F.col("count").between(max(1.0, band[0] * n), band[1] * n)).select("term").orderBy("term")
    return [r["term"] for r in rows.collect()]


def _literal(term: str) -> str:
    return "'" + term.replace("\\", "\\\\").replace("'", "\\'") + "'"


def with_fingerprint(rows: DataFrame, text: str, lexicon: list[str], into: str) -> DataFrame:
    """Add the row of subset hashes (0 for a subset without terms)."""
    name = lambda x: f"_{into}_{x}"
    others = rows.columns
    listed = ", ".join(map(_literal, lexicon)) or "NULL"
    rows = rows.withColumn(name("terms"), terms_of(F.col(text)))
    rows = rows.withColumn(name("band"), F.expr(f"filter({name('terms')}, t -> t IN ({listed}))"))
    own = F.sort_array(F.when(F.size(name("band")) > 0, F.col(name("band"))).otherwise(F.col(name("terms"))))
    rows = rows.withColumn(name("hashed"), F.transform(own, lambda t: F.xxhash64(t)))
    # a term is in a subset if the drawing's first bits of its hash are zero; no terms hash to 42, the seed
    masks = ", ".join(str((1 << halving) - 1) for halving in HALVINGS)
    drawn = [F.expr(f"transform(array({masks}), m -> (xxhash64(filter({name('hashed')}, h -> (shiftright(h, {8 * draw}) & m) = 0)) ^ 42) & 4294967295)")
             for draw in range(DRAWS)]
    return rows.select(*others, F.flatten(F.array(*drawn)).alias(into))


def as_hex(prints: str) -> Column:
    return F.array_join(F.transform(prints, lambda h: F.lpad(F.lower(F.hex(h)), 8, "0")), "")


def likeness(a: str, b: str) -> Column:
    """Share of subsets with equal hashes among those in which either text has terms; 1 if there are none."""
    pairs = F.arrays_zip(F.col(a).alias("a"), F.col(b).alias("b"))
    any_ = F.size(F.filter(pairs, lambda p: (p["a"] != 0) | (p["b"] != 0)))
    same = F.size(F.filter(pairs, lambda p: (p["a"] != 0) & (p["a"] == p["b"])))
    return F.when(any_ > 0, same / any_).otherwise(1.0)


def next_ids(ids: DataFrame) -> DataFrame:
    """``id``, ``next``: the following id by descending order, after the last the first; a missing id comes last."""
    order = [F.col("id").desc_nulls_last()]
    placed = materialize(
        ids.distinct().repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ids")
    # ids fall as parts rise; a missing id is in the last part
    heads = placed.groupBy("part").agg(F.max(F.struct(F.col("id").isNotNull(), "id")).alias("head"))
    heads = heads.select("part", F.col("head.id").alias("head"), F.lit(True).alias("any"))
    one = Window.orderBy("part")
    follow = heads.select("part", F.coalesce(F.lead(F.struct("head")).over(one), F.first(F.struct("head")).over(one)).alias("after"))
    inside = Window.partitionBy("part").orderBy(*order)
    return placed.withColumn("inner", F.lead(F.struct("id")).over(inside)).join(F.broadcast(follow), "part").select(
        "id", F.coalesce(F.col("inner.id"), F.when(F.col("inner").isNull(), F.col("after.head"))).alias("next"))


def fingerprint_documents(docs: DataFrame, *, text: str = "text", id_column: str = "doc_id",
                          band: tuple[float, float] = BAND) -> DataFrame:
    """Per row: id, ``n_chars``, ``edited_sha256``, both fingerprints, ``near_edited`` and ``near_next``."""
    lexicon = fit_lexicon(docs, text, band)
    # ids are joined by two columns that are never null, so that one dealing of the texts serves both joins
    key = lambda c, name: [F.col(c).isNull().alias(f"{name}_none"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name)]
    rows = docs.select(F.col(id_column).alias("id"), *key(id_column, "own"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # of each id, half the characters of its longest row are fetched from the next one
    sizes = materialize(rows.groupBy("id").agg(F.max(F.length("text")).alias("most")), "lengths")
    ids = next_ids(sizes.select("id"))
    wanted = materialize(ids.join(sizes, ids["id"].eqNullSafe(sizes["id"])).select(
        ids["id"].alias("id"), "next", F.floor(F.col("most") / 2).cast("int").alias("half")).select(
        *key("id", "before"), *key("next", "next"), "half"), "next-ids")
    # both joins use the same columns of this, so its dealing is done once; the id is read back from its text
    marked = with_fingerprint(rows.drop("id"), "text", lexicon, "prints")
    given = marked.join(wanted, (F.col("own_none") == F.col("next_none")) & (F.col("own") == F.col("next"))).select(
        "before_none", "before", F.struct(F.col("text").substr(F.lit(1), F.col("half")).alias("text"), "prints").alias("given"))
    given = given.groupBy("before_none", "before").agg(F.min("given").alias("given"))
    joined = marked.join(given, (F.col("own_none") == F.col("before_none")) & (F.col("own") == F.col("before"))).select(
        F.when(~F.col("own_none"), F.col("own").cast(docs.schema[id_column].dataType)).alias("id"),
        "text", "prints", F.col("given.text").alias("next_text"), F.col("given.prints").alias("next_prints"),
        F.length("text").alias("n_chars"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.col("text").substr(F.lit(1), F.col("n_chars") - half), F.col("next_text").substr(F.lit(1), half))
    edited = joined.select("id", "n_chars", "prints", "next_prints", edited.alias("edited"))
    both = with_fingerprint(edited, "edited", lexicon, "edited_prints")
    return both.select(
        F.col("id").alias(id_column), F.col("n_chars").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), as_hex("prints").alias("fingerprint"),
        as_hex("edited_prints").alias("edited_fingerprint"), likeness("prints", "edited_prints").alias("near_edited"),
        likeness("prints", "next_prints").alias("near_next"))
