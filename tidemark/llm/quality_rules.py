"""Quality rules: counts for each document, and lines that recur across the documents of a host."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .expressions import let
from .store import cut

#: Characters that count as symbols, and the white space between words.
SYMBOLS = "#*$%&|<>"
SPACE = r"[\x20\x09-\x0D]+"
#: Hosts up to which their recurring lines are sent to all executors; beyond, they are joined by host.
BROADCAST_HOSTS = 20_000


def _window_hashes(words: Column, width: int) -> Column:
    """64-bit hashes of all windows of ``width`` words, built by doubling (1, 2, 4, 8), so ``width`` is a power of two."""

    def doubled(step: int) -> Callable[[Column], Column]:
        return lambda h: F.slice(F.zip_with(h, F.slice(h, F.lit(1 + step), F.size(h)), lambda x, y: F.xxhash64(x, y)), F.lit(1), F.greatest(F.size(h) - step, F.lit(0)))

    hashes, step = F.transform(words, lambda w: F.xxhash64(w)), 1
    while step < width:
        hashes, step = let(hashes, doubled(step)), 2 * step
    return hashes


def _covered(hashes: Column, width: int) -> Column:
    """Size of the union of [i, i + width) over the places i of hashes that occur more than once."""
    null = F.array(F.lit(None).cast("struct<h:bigint,i:int>"))

    def places(ranked: Column) -> Column:
        with_before = F.zip_with(ranked, F.concat(null, ranked), lambda x, y: F.struct(x["i"].alias("i"), x["h"].alias("h"), (x["h"] == y["h"]).alias("p")))
        twice = F.zip_with(with_before, F.slice(ranked, F.lit(2), F.size(ranked)), lambda x, y: F.when(F.coalesce(x["p"], F.lit(False)) | F.coalesce(x["h"] == y["h"], F.lit(False)), x["i"]))
        return F.sort_array(F.filter(twice, lambda i: i.isNotNull()))

    def total(at: Column) -> Column:
        spans = F.zip_with(at, F.slice(at, F.lit(2), F.size(at)), lambda i, j: F.least(F.coalesce(j - i, F.lit(width)), F.lit(width)))
        return F.aggregate(spans, F.lit(0).cast("long"), lambda a, x: a + x)

    ranked = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return let(let(ranked, places), total)


def _repeat_words(words: Column, width: int) -> Column:
    """Words inside windows of ``width`` words that the text has twice or more; most texts need no sorting."""
    none = F.lit(0).cast("long")
    return let(_window_hashes(words, width), lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), _covered(h, width)).otherwise(none))


def base_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), window: int = 8) -> DataFrame:
    """Counts of each row by itself, and the columns in ``keep``."""
    t = docs.select(F.col(id_col).alias("id"), *[F.col(k) for k in keep], F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    words = F.array_remove(F.split("t", SPACE), "")
    of_words = let(
        words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), _repeat_words(w, window).alias("n_repeat_words"))
    )
    dup = let(F.filter(F.split("t", "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]")), lambda ls: (F.size(ls) - F.size(F.array_distinct(ls))).cast("long"))
    symbols = F.length(F.regexp_replace("t", r"[^#*$%&|<>]+", "")).cast("long")
    t = t.select("id", *keep, of_words.alias("w"), symbols.alias("n_symbols"), dup.alias("n_dup_lines"))
    return t.select("id", *keep, "w.n_words", "w.word_chars", "n_symbols", "n_dup_lines", "w.n_repeat_words")


def _lines(text: Column) -> Column:
    """Lines with a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]"))


def _normal(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), SPACE, " "))


def _frequent(own: DataFrame, percent: int, min_docs: int) -> DataFrame:
    """(host, common) from rows (host, doc, lines): hashes of a text and of its lines."""
    own = own.groupBy("host", "doc").agg(F.first("lines").alias("lines"))
    counted = own.select("host", F.explode("lines").alias("line")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs)
    sizes = own.groupBy("host").agg(F.count(F.lit(1)).alias("size")).select(F.col("host").alias("host2"), "size")
    frequent = counted.join(sizes, F.col("host").eqNullSafe(F.col("host2"))).where(100 * F.col("n") > percent * F.col("size"))
    return frequent.groupBy("host").agg(F.collect_list("line").alias("common"))


def _text_hash(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def common_lines(docs: DataFrame, text_col: str = "text", host_col: str = "source", percent: int = 5, min_docs: int = 5) -> DataFrame:
    """(host, common): hashes of the normalised lines that more than ``percent`` of a hundred distinct documents of a
    host have, and ``min_docs`` of them at least.

    Documents of a host with equal texts are one. Of all lines of a host's documents fewer than 100 / ``percent``
    times the mean number of lines of a document can be so frequent, so the lists are short.
    """
    lines = F.array_distinct(F.transform(_lines(F.col(text_col)), lambda s: F.xxhash64(_normal(s))))
    return _frequent(docs.select(F.col(host_col).alias("host"), _text_hash(text_col).alias("doc"), lines.alias("lines")), percent, min_docs)


def _with_common(rows: DataFrame, common: DataFrame) -> DataFrame:
    """``rows`` with the lines that are common on their ``host``."""
    common = cut(common, "common-lines").select(F.col("host").alias("host2"), "common")
    common = F.broadcast(common) if common.count() <= BROADCAST_HOSTS else common
    none = F.array().cast("array<bigint>")
    return rows.join(common, F.col("host").eqNullSafe(F.col("host2")), "left").drop("host2").withColumn("common", F.coalesce("common", none))


def without_common_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", percent: int = 5, min_docs: int = 5) -> DataFrame:
    """One row for each input row: id and the text without the lines that are common on its host. Null texts stay null.

    Other lines, empty ones too, stay as they are.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), F.col(host_col).alias("host"))
    rows = _with_common(rows, common_lines(docs, text_col, host_col, percent, min_docs))
    kept = F.filter(F.split("t", "\n"), lambda s: ~(s.rlike(r"[^\x20\x09-\x0D]") & F.array_contains(F.col("common"), F.xxhash64(_normal(s)))))
    return rows.select(F.col("id").alias(id_col), F.when(F.size("common") == 0, F.col("t")).otherwise(F.array_join(kept, "\n")).alias(text_col))


def quality_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", percent: int = 5, min_docs: int = 5, min_left: int = 50, min_words: int = 20
) -> DataFrame:
    """One row for each input row: counts, base_failed, removed_words and kept.

    A line that more than ``percent`` of a hundred distinct documents of one host have, and ``min_docs`` at least, is
    removed from all documents of that host. A document is rejected if it fails a base rule, or if what is left has fewer
    than ``min_words`` words or less than ``min_left`` of a hundred of those it had. Null texts count as empty and fail for want of words. Every row is
    judged by itself, whatever its id; rows of a host with equal texts are one document where lines are counted. A
    null host is a host of its own. An empty table gives an empty result. ``without_common_lines`` gives the texts.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), F.col(host_col).alias("host"))
    words = lambda s: let(_normal(s), lambda x: F.struct(F.xxhash64(x).alias("h"), (F.length(x) - F.length(F.replace(x, F.lit(" "))) + 1).cast("long").alias("n")))
    # Texts are read once: their counts, and the hashes and sizes of their lines, are all that both steps need.
    rows = rows.withColumns({"lines": F.transform(_lines(F.col("t")), words), "doc": _text_hash("t")})
    table = cut(base_counts(rows, "id", "t", keep=("host", "doc", "lines")), "lines")
    each = _with_common(table, _frequent(table.select("host", "doc", F.array_distinct("lines.h").alias("lines")), percent, min_docs))
    removed = F.aggregate("lines", F.lit(0).cast("long"), lambda a, s: a + F.when(F.array_contains(F.col("common"), s["h"]), s["n"]).otherwise(F.lit(0).cast("long")))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    each = each.withColumn("removed_words", removed)
    left = F.col("n_words") - F.col("removed_words")
    return each.select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & (left >= min_words) & (100 * left >= min_left * F.col("n_words"))).alias("kept"), "removed_words",
    )
