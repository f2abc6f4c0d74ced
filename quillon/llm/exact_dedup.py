"""Exact deduplication by content-defined chunk recipes (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import SPACE, fresh, whole
from quillon.staging import staged

#: A window is a cut where its bytes have an odd (1) or even (0) number of one bits, in this order.
CUT_BITS = "10011010111100010"
#: Bytes from one byte of a window to the next: every script's characters, of 1 to 4 bytes, come round in the same phase.
STRIDE = 12


def _parity(bit: str) -> str:
    return "[" + "".join(f"\\x{b:02x}" for b in range(256) if b.bit_count() % 2 == int(bit)) + "]"


def cut_window(bits: int) -> str:
    """A regular expression that one of ``2**bits`` places of a text of bytes meets, whatever its script."""
    return ("." * (STRIDE - 1)).join(_parity(b) for b in CUT_BITS[:bits])


def chunk_pattern(least: int = 1024, most: int = 4096) -> str:
    """A regular expression whose successive matches tile a text of bytes, written as Latin-1 characters.

    A chunk ends behind the first window (:func:`cut_window`) that begins ``least`` to ``most`` bytes after its start; one is
    expected every ``least / 4`` bytes. Being chosen by the bytes and not by an offset, cuts meet again soon after an
    insertion. Only text in which no window is met, as a run of one character, is cut every ``most`` bytes.
    """
    bits = min(len(CUT_BITS), max(1, (least // 4).bit_length() - 1))
    return rf"(?s).{{{least},{most}}}?(?:{cut_window(bits)}|\z)|.{{1,{most}}}"


def _chunks(norm: Column, least: int, most: int) -> Column:
    """The chunks of a normalised text, each as Latin-1 characters for its UTF-8 bytes."""
    return F.regexp_extract_all(F.decode(norm.cast("binary"), "ISO-8859-1"), F.lit(chunk_pattern(least, most)), F.lit(0))


def recipes(docs: DataFrame, id_col: str, text_col: str, least: int, most: int, keep_text: bool = False) -> DataFrame:
    """Per row: its number, id, code points, digest of the normalised text and the ordered chunk identifiers."""
    norm = docs.select(
        F.col(id_col).alias("doc_id"),
        F.char_length(whole(text_col)).alias("n_points"),
        F.xxhash64(whole(text_col)).alias("text_hash"),
        F.regexp_replace(whole(text_col), f"{SPACE}+", "").alias("norm"),
    )
    return norm.select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        "n_points",
        "text_hash",
        F.sha2("norm", 256).alias("text_sha256"),
        F.transform(_chunks(F.col("norm"), least, most), lambda c: F.unhex(F.sha2(c, 256))).alias("recipe"),
        (F.col("norm") if keep_text else F.lit(None).cast("string")).alias("norm"),
    )


def ambiguous_chunks(docs: DataFrame, text_col: str = "text", least: int = 1024, most: int = 4096) -> DataFrame:
    """Identifiers that name more than one content.

    Chunks are deduplicated by their whole content, before the shuffle within each task and after it
    across tasks, so a content moves about once however often it occurs; only identifiers go on from there.
    """
    norm = F.regexp_replace(whole(text_col), f"{SPACE}+", "")
    chunks = docs.select(F.explode(_chunks(norm, least, most)).alias("chunk"))
    contents = chunks.select(F.unhex(F.sha2("chunk", 256)).alias("id"), "chunk").groupBy("id", "chunk").agg(F.lit(1))
    return contents.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id")


def with_own_text(rows: DataFrame, bad: DataFrame) -> DataFrame:
    """``norm`` stays where the recipe holds an identifier in ``bad``, and is null elsewhere."""
    hit = rows.select("row", F.explode("recipe").alias("id")).join(bad, "id", "left_semi").select("row").distinct()
    hit = hit.withColumn("hit", F.lit(True))
    return rows.join(hit, "row", "left").withColumn("norm", F.when(F.col("hit"), F.col("norm"))).drop("hit")


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 1024, most: int = 4096
) -> DataFrame:
    """Group rows whose texts are equal once ASCII white space is deleted.

    Returns one row per input row: ``doc_id``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256`` and
    ``text_hash`` (of the text as it is, to tell apart rows that share an id).

    The text of a document is cut into content-defined chunks; chunks get SHA-256 identifiers that are
    verified against the contents, and documents are compared by their ordered identifier lists alone.
    A document that holds an identifier with two contents is compared by its whole normalised text too.

    Of a group the row with the most code points stays, then the smallest id, then the first row read:
    repeated rows leave one. Ids may be of any type that has an order; a null id loses against any other. A very long
    text is one list of 32-byte identifiers. Null texts count as empty; empty texts
    are equal to each other and to texts of white space. An empty table gives an empty result; other
    columns, whatever their names, are not read.
    """
    rows = staged(recipes(docs, id_col, text_col, least, most), "recipes")
    bad = staged(ambiguous_chunks(docs, text_col, least, most), "ambiguous-chunks")
    if not bad.isEmpty():
        rows = with_own_text(staged(recipes(docs, id_col, text_col, least, most, keep_text=True), "recipes"), bad)
    # The least of these is the row that stays; a null id comes after any other.
    best = F.min(F.struct((-F.col("n_points")).alias("less"), F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row"))
    groups = (
        rows.groupBy("recipe", "norm")
        .agg(best.alias("best"), F.count("*").alias("group_size"))
        .select(
            F.col("recipe").alias("g_recipe"),
            F.col("norm").alias("g_norm"),
            F.size("recipe").alias("g_chunks"),
            F.col("best.doc_id").alias("keep_id"),
            F.col("best.row").alias("keep_row"),
            "group_size",
        )
    )
    # The number of chunks is one more join key: both sides are then dealt out anew for the join, which
    # lets adaptive execution split the members of a hot group.
    same = (
        (F.col("recipe") == F.col("g_recipe"))
        & (F.size("recipe") == F.col("g_chunks"))
        & F.col("norm").eqNullSafe(F.col("g_norm"))
    )
    return rows.join(groups, same).select(
        "doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256", "text_hash"
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that :func:`exact_groups` keeps, with all their columns.

    Of rows that agree in id and text, one stays.
    """
    keep = exact_groups(docs, id_col, text_col).where("kept").select(F.col("doc_id").alias("keep_id"), F.col("text_hash").alias("keep_hash"))
    hash_col = fresh(docs, "text_hash")
    rows = docs.withColumn(hash_col, F.xxhash64(whole(text_col)))
    same = rows[id_col].eqNullSafe(keep["keep_id"]) & (rows[hash_col] == keep["keep_hash"])
    return rows.join(keep, same, "left_semi").dropDuplicates([id_col, hash_col]).drop(hash_col)
