"""Document fingerprints: Merkle trees over sections, paragraphs and clauses.  DataFrame functions only.

Sections are divided by an empty line, paragraphs by a line feed, clauses by a blank
after one of ``. ! ? , ; |``.  A clause's hash is the SHA-256 of its text, every other
node's the SHA-256 of its children's hashes put together.  The root thus stands for the
exact text: equal roots, equal texts.

A fingerprint is the root (64 hex digits), ``|``, and the first 12 hex digits of each
clause's hash, with ``,`` between clauses, ``/`` between paragraphs and ``;`` between
sections, so that two fingerprints show in which branches the texts differ.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Stands for a null id in the order of documents: before all others.
LEAST_ID = -(2**63)
#: Ranges of ids for each shuffle partition.
RANGES = 4
#: Characters of a text that split the rows of one id, where these are too many.
HEAD = 16


def sha(x: Column) -> Column:
    return F.sha2(x, 256)


def tree(text: Column) -> Column:
    """Clause hashes by section and paragraph."""
    clauses = lambda p: F.split(F.regexp_replace(p, r"([.!?,;|]) ", "$1\n"), "\n")
    return F.transform(F.split(text, "\n\n"), lambda s: F.transform(F.split(s, "\n"), lambda p: F.transform(clauses(p), sha)))


def fingerprint_of(nodes: Column) -> Column:
    """The fingerprint of a tree."""
    root = sha(F.array_join(F.transform(nodes, lambda s: sha(F.array_join(F.transform(s, lambda p: sha(F.array_join(p, ""))), ""))), ""))
    short = lambda p: F.array_join(F.transform(p, lambda x: F.substring(x, 1, 12)), ",")
    return F.concat(root, F.lit("|"), F.array_join(F.transform(nodes, lambda s: F.array_join(F.transform(s, short), "/")), ";"))


def fingerprint(text: Column) -> Column:
    """The fingerprint of a text; null is the empty text."""
    return fingerprint_of(tree(F.coalesce(text, F.lit(""))))


def leaves(fp: Column) -> Column:
    """The distinct clauses of a fingerprint."""
    return F.array_distinct(F.split(F.substring(fp, 66, 2**31 - 1), "[,/;]"))


def likeness(a: Column, b: Column) -> Column:
    """1 if the roots are equal, else the share of clauses in common (Dice, distinct clauses)."""
    x, y = leaves(a), leaves(b)
    shared = 2.0 * F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y))
    return F.when(F.substring(a, 1, 64) == F.substring(b, 1, 64), F.lit(1.0)).otherwise(shared)


def with_next(docs: DataFrame, id_col: str, text_col: str, also: dict[str, Column]) -> DataFrame:
    """Each document with the next one in ascending order of ids; after the last comes the first.

    Gives ``id``, ``text``, ``next_text`` and, for each column of ``also`` (a function of
    ``text``), the column and ``next_`` with its name.  Null text becomes the empty text,
    null ids come first, equal ids are ordered by text.

    Nothing is sorted in one place: the ids alone are range-partitioned to get the first
    id of each range (as many values as ranges, RANGES a shuffle partition, come to the
    driver), then texts are dealt by range, and the first document of a range is dealt a
    second time, as the end of the range before.  One shuffle of the texts; a window per range
    finds the next.  A range is looked up in two steps: a few ids in the plan give its
    group, and a broadcast table the group's ranges.

    If an id, or null, has more rows than a range should, ranges are cut within it as well:
    by the beginning of the text and then by its hash.  Rows of one id with the same
    beginning are then ordered by the hash; only identical rows stay together.
    """
    spark = docs.sparkSession
    key, text = F.coalesce(F.col(id_col).cast("long"), F.lit(LEAST_ID)), F.coalesce(F.col(text_col), F.lit(""))
    n_ranges = RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows, most = docs.select(key.alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n"), F.max("n")).first()
    crowded = (most or 0) > max(2, (rows or 0) // n_ranges)
    within = (F.substring(text, 1, HEAD), F.xxhash64(text)) if crowded else (F.lit(""), F.lit(0).cast("long"))
    place = F.struct(key.alias("key"), within[0].alias("head"), within[1].alias("hash"))
    ids = docs.select(place.alias("at"))
    firsts = [r[0] for r in ids.repartitionByRange(n_ranges, "at").groupBy(F.spark_partition_id()).agg(F.min("at").alias("at")).select("at").orderBy("at").collect()]
    firsts = firsts or [(LEAST_ID, "", 0)]
    step = max(1, int(len(firsts) ** 0.5))
    groups = [firsts[i : i + step] for i in range(0, len(firsts), step)]
    kind = "struct<key: bigint, head: string, hash: bigint>"
    listed = F.broadcast(spark.createDataFrame([(i + 1, [tuple(x) for x in g]) for i, g in enumerate(groups)], f"group int, firsts array<{kind}>"))
    heads = F.from_json(F.lit(json.dumps([dict(zip(("key", "head", "hash"), g[0], strict=True)) for g in groups])), f"array<{kind}>")
    upto = lambda values: F.size(F.filter(values, lambda x: x <= F.col("at")))
    rows = docs.select(place.alias("at"), F.col(id_col).alias("id"), text.alias("text"))
    rows = rows.withColumn("group", upto(heads)).join(listed, "group").withColumn("nth", upto(F.col("firsts")))
    rows = rows.withColumn("range", (F.col("group") - 1) * step + F.col("nth")).withColumn("first", F.element_at("firsts", F.col("nth")) == F.col("at"))
    before = F.when(F.col("range") == 1, F.lit(len(firsts))).otherwise(F.col("range") - 1)
    here = F.struct(F.col("range"), F.lit(0).alias("end"))
    places = F.when(F.col("first"), F.array(here, F.struct(before.cast("int").alias("range"), F.lit(1).alias("end")))).otherwise(F.array(here))
    names = list(also)
    rows = rows.select("at", "id", "text", *(c.alias(x) for x, c in also.items()), F.explode(places).alias("place"))
    window = Window.partitionBy("place.range").orderBy("place.end", "at", "text")
    rows = rows.select("id", "text", *names, "place.end", *(F.lead(x).over(window).alias(f"next_{x}") for x in ("text", *names)))
    return rows.filter("end = 0").drop("end")


def edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of documents and of edited texts, and how alike they are.

    The edited text is the text with its last floor(n/2) of n code points replaced by as
    many first ones of the next document (or all that it has).  Columns: the id,
    ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``,
    ``near_edited`` and ``near_next`` (likeness of the fingerprint to the edited text's
    and to the next document's).

    Null and empty texts are the empty text; their edited text is empty, so the likeness
    is 1.  A single document is its own next one.  Repeated rows are documents of their
    own; an empty table gives an empty result.
    """
    rows = with_next(docs, id_col, text_col, {"fingerprint": fingerprint(F.col("text"))})
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    rows = rows.select("id", "fingerprint", "next_fingerprint", n.cast("long").alias("n_chars"), edited.alias("edited"))
    rows = rows.select("id", "n_chars", sha(F.col("edited")).alias("edited_sha256"), "fingerprint", "next_fingerprint", fingerprint(F.col("edited")).alias("edited_fingerprint"))
    return rows.select(F.col("id").alias(id_col), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))
