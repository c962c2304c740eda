"""Quality rules: base rules on words and lines, and a hashed n-gram log-likelihood ratio.

The ratio compares two multinomials over hashed unigrams and bigrams: one of trusted rows, one of all rows.
An n-gram's ratio sets its count in trusted rows against the count that its share of all rows lets expect, each
with the mean count of a bucket added, so the scale of the ratios does not depend on the size of the table; the
occurrence that is judged does not count for itself.  A document's score is the mean over its n-grams, so its length
does not matter.  One threshold, which every document meets, is set between the scores of rows labelled good
and rows labelled bad; there the own occurrences of trusted rows are left out, as those of other rows are absent.
All of it is DataFrame expressions.

Defined results: null text counts as no words; a document without words has score null and fails the
base rules; with no trusted row there is no model, the score is null and only the base rules decide; without bad
rows the threshold lies below the good ones; repeated rows are judged one by one; a null id has no label.  Columns of
the input pass through, but those called like a column of the verdict, in any letter case, give way to it in ``judge``;
``kept_rows`` returns them all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan.llm.common import ASCII_SPACE, own_columns, place, positional, stored
from veilspan.operators import scan

BUCKETS = 1 << 14
GOOD_SHARE, BAD_SHARE = 0.01, 0.98
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
_SPACE = r"[\x20\x09-\x0D]+"


def _length(items: Column) -> Column:
    return F.size(items).cast("long")


def with_words(docs: DataFrame, text: str = "text", out: str = "_words") -> DataFrame:
    """Words are runs of anything but ASCII white space."""
    trimmed = F.btrim(F.coalesce(F.col(text), F.lit("")), F.lit(ASCII_SPACE))
    docs = docs.withColumn("_trimmed", trimmed)
    none = F.array().cast("array<string>")
    return docs.withColumn(out, F.when(F.col("_trimmed") == "", none).otherwise(F.split("_trimmed", _SPACE))).drop("_trimmed")


def with_base(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed to rows with _words."""
    body = F.coalesce(F.col(text), F.lit(""))
    docs = docs.withColumn("_lines", F.filter(F.split(body, "\n"), lambda x: F.length(F.btrim(x, F.lit(ASCII_SPACE))) > 0))
    docs = docs.withColumns({
        "n_words": _length(F.col("_words")),
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_symbols": (F.length(body) - F.length(F.regexp_replace(body, r"[#*$%&|<>]+", ""))).cast("long"),
        "n_dup_lines": _length(F.col("_lines")) - _length(F.array_distinct("_lines")),
        # Windows are compared by 64-bit hashes.
        "_windows": F.expr("""transform(sequence(0, greatest(size(_words) - 3, 0)), i ->
            xxhash64(get(_words, i), get(_words, i + 1), get(_words, i + 2)))"""),
    }).drop("_lines")
    docs = docs.withColumn("_sorted", F.expr("""
        CASE WHEN size(_words) < 3 OR size(array_distinct(_windows)) = size(_windows)
             THEN cast(array() AS array<struct<h: bigint, i: int>>)
             ELSE sort_array(transform(_windows, (h, i) -> named_struct('h', h, 'i', i))) END"""))
    # Starts of windows that equal a neighbour in hash order, back in text order.
    docs = docs.withColumn("_starts", F.expr("""sort_array(transform(filter(_sorted, (e, k) ->
        e.h <=> get(_sorted, k - 1).h OR e.h <=> get(_sorted, k + 1).h), e -> e.i))"""))
    # Each start covers three words, or as many as there are up to the next start.
    docs = docs.withColumn("n_repeat_words", F.expr("""aggregate(
        transform(_starts, (p, k) -> least(3, coalesce(get(_starts, k + 1) - p, 3))), 0L, (a, x) -> a + x)"""))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return docs.withColumn("base_failed", failed).drop("_windows", "_sorted", "_starts")


def _ngrams(buckets: int) -> Column:
    return F.expr(f"""flatten(array(
        transform(_words, w -> cast(pmod(xxhash64(w), {buckets}) AS int)),
        transform(sequence(1, size(_words) - 1, 1), i ->
            cast(pmod(xxhash64(get(_words, i - 1), get(_words, i)), {buckets}) AS int))))""")


def _with_ngrams(docs: DataFrame, buckets: int) -> DataFrame:
    one = F.expr(f"transform(_words, w -> cast(pmod(xxhash64(w), {buckets}) AS int))")
    return docs.withColumn("_ngrams", F.when(F.size("_words") > 1, _ngrams(buckets)).otherwise(one))


def _texts(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    return positional(docs).select(F.col(place(docs, id_col)).alias("_id"), F.col(place(docs, text)).alias("_text"))


def _grams(texts: DataFrame, buckets: int, name: str) -> DataFrame:
    rows = _with_ngrams(with_words(texts, "_text"), buckets).select(F.explode_outer("_ngrams").alias("bucket"))
    # The inner form would let a filter on the array size be pushed down and the text be split once per n-gram.
    return rows.where("bucket IS NOT NULL").groupBy("bucket").agg(F.count("*").alias(name))


def _counts(texts: DataFrame, trusted: DataFrame, buckets: int) -> DataFrame:
    every = _grams(texts, buckets, "n_corpus").join(_grams(trusted, buckets, "n_trusted"), "bucket", "left")
    return every.fillna(0, ["n_trusted"])


def bucket_counts(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text: str = "text",
                  buckets: int = BUCKETS) -> DataFrame:
    """Counts of hashed n-grams in all rows and in the trusted ones: at most ``buckets`` rows."""
    ids = trusted.select(F.col(id_col).alias("_id")).where("_id IS NOT NULL").distinct()
    rows = _texts(docs, id_col, text)
    # The labels grow with the corpus, so they are never broadcast.
    return _counts(rows, rows.join(ids.hint("merge"), "_id"), buckets)


def log_ratios(counts: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """One row: the log ratios by bucket, for an occurrence in a row that is not trusted (``ratios``) and in one that is (``own_ratios``).

    Null if nothing is trusted.  The arrays have ``buckets`` entries whatever the corpus.
    """
    every = F.broadcast(counts.agg(F.sum("n_corpus").alias("_all"), F.sum("n_trusted").alias("_good")))
    rest = F.greatest(F.col("n_corpus") - 1, F.lit(0))
    expected, mean = rest * (F.col("_good") / F.col("_all")), F.greatest("_good", F.lit(1)) / buckets
    ratio = lambda found: F.log((found + mean) / (expected + mean))
    dense = counts.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left")
    dense = dense.fillna(0, ["n_corpus", "n_trusted"]).crossJoin(every).select(  # one row of totals
        "bucket", "_good", ratio(F.col("n_trusted")).alias("r"), ratio(F.greatest(F.col("n_trusted") - 1, F.lit(0))).alias("own"))
    pairs = F.sort_array(F.collect_list(F.struct("bucket", "r", "own")))
    some = F.max("_good") > 0
    return dense.agg(F.when(some, F.transform(pairs, lambda x: x["r"])).alias("ratios"),
                     F.when(some, F.transform(pairs, lambda x: x["own"])).alias("own_ratios"))


def _score(ratios: str) -> Column:
    return F.when(F.size("_ngrams") > 0, F.expr(f"aggregate(_ngrams, 0D, (a, b) -> a + get({ratios}, b))") / F.size("_ngrams"))


def labelled_texts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (_text, _good) of all labelled rows: good and trusted, or labelled bad; other labels say nothing."""
    good = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), True).when(F.col("quality") == 0, False)
    rows = labels.select(F.col(id_col).alias("_id"), good.alias("_good")).where("_id IS NOT NULL AND _good IS NOT NULL")
    one = rows.groupBy("_id").agg(F.max("_good").alias("_good"))  # as trusted as any of its labels
    # The labels grow with the corpus, so they are never broadcast.
    return _texts(docs, id_col, text).join(one.hint("merge"), "_id").select("_text", "_good")


def threshold_of(docs: DataFrame, labels: DataFrame, ratios: DataFrame, id_col: str = "doc_id", text: str = "text",
                 buckets: int = BUCKETS) -> DataFrame:
    """One row: ``threshold``, midway between the lowest scores of good and the highest of bad rows, of all labelled ones.

    "Lowest" and "highest" leave out the farthest hundredth of the good and fiftieth of the bad rows.  If the two overlap, it
    keeps all but the lowest of the good; without bad rows it lies below the good ones by their spread.
    """
    return _threshold(labelled_texts(docs, labels, id_col, text), ratios, buckets)


def _percentile(share: float) -> Column:
    """What a row with ``s``, its ``rank`` from 1 and the number of rows ``n`` adds to the percentile between two ranks."""
    at, rank = F.lit(share) * (F.col("n") - 1), F.col("rank") - 1
    below, above = F.floor(at), F.ceil(at)
    return (F.when((rank == below) & (below == above), F.col("s")).when(rank == below, (above - at) * F.col("s"))
            .when(rank == above, (at - below) * F.col("s")))


def _threshold(labelled: DataFrame, ratios: DataFrame, buckets: int) -> DataFrame:
    rows = _with_ngrams(with_base(with_words(labelled, "_text"), "_text"), buckets)
    rows = rows.withColumns({"_own": ratios.select("own_ratios").scalar(), "_ratios": ratios.select("ratios").scalar()})
    scored = F.struct("_good", "base_failed", F.when(F.col("_good"), _score("_own")).otherwise(_score("_ratios")).alias("s"))
    # Through a generator, as in ``_judged``.
    scored = rows.select(F.explode_outer(F.array(scored)).alias("v")).select("v.*").where("NOT base_failed AND s IS NOT NULL")
    scored = stored(scored.select("_good", "s"), "scores")  # read twice
    # Ranks come from ranged rows, so the labelled scores are never in one task.
    ranked = scan.numbered(scored, ["_good"], [F.col("s")], "rank").join(
        F.broadcast(scored.groupBy("_good").agg(F.count("*").alias("n"))), "_good")  # two rows
    found = ranked.agg(F.sum(F.when(F.col("_good"), _percentile(GOOD_SHARE))).alias("low"),
                       F.sum(F.when(F.col("_good"), _percentile(0.5))).alias("middle"),
                       F.max(F.when(F.col("_good"), F.col("n"))).alias("n"),
                       F.sum(F.when(~F.col("_good"), _percentile(BAD_SHARE))).alias("bad"))
    spread = F.col("middle") - F.col("low")
    between = F.greatest((F.col("low") + F.col("bad")) / 2, F.col("low") - spread)
    # The lower end of few good rows is not known well: the fewer they are, the more room is left below it.
    room = F.col("low") - 2 * spread / F.sqrt("n")
    return found.select(F.when(F.col("bad").isNull(), F.col("low") - spread).when(F.col("bad") >= F.col("low"), room)
                        .otherwise(F.least(between, room)).alias("threshold"))


VERDICT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def _judged(docs: DataFrame, labels: DataFrame, id_col: str, text: str, threshold: float | None, buckets: int) -> DataFrame:
    """The columns of ``docs`` under positional names, and ``verdict``."""
    labelled = labelled_texts(docs, labels, id_col, text)
    if threshold is None:
        labelled = stored(labelled, "labelled", "zstd")  # read twice; the texts of all rows are shuffled for it once
    counts = _counts(_texts(docs, id_col, text), labelled.where("_good"), buckets)
    ratios = stored(log_ratios(counts, buckets), "ratios")  # one row, read several times
    if threshold is None:
        limit = stored(_threshold(labelled, ratios, buckets), "threshold").scalar()
    else:
        limit = F.lit(threshold)
    body = place(docs, text)
    rows = _with_ngrams(with_base(with_words(positional(docs), body), body), buckets)
    rows = rows.withColumn("_ratios", ratios.select("ratios").scalar()).withColumn("score", _score("_ratios"))
    kept = ~F.col("base_failed") & F.coalesce(F.col("score") >= limit, F.lit(True))
    verdict = F.struct(*[kept.alias("kept") if c == "kept" else F.col(c) for c in VERDICT])
    # Through a generator: a later filter on the verdict is not pushed down, which would copy the expressions above into it.
    return rows.select(*positional(docs).columns, F.explode_outer(F.array(verdict)).alias("verdict"))


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text",
          threshold: float | None = None, buckets: int = BUCKETS) -> DataFrame:
    """All columns of ``docs`` with the base features, ``base_failed``, ``kept`` and ``score``.

    ``labels`` has the id, ``quality`` and ``toxic``.  Without a ``threshold`` it is set from all labelled rows.
    """
    judged = _judged(docs, labels, id_col, text, threshold, buckets)
    return judged.select(*own_columns(docs, VERDICT), "verdict.*")


def kept_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: float | None = None,
              buckets: int = BUCKETS) -> DataFrame:
    """The rows of ``docs`` that the rules keep, as they are."""
    return _judged(docs, labels, id_col, text, threshold, buckets).where("verdict.kept").select(*own_columns(docs))


def trusted_labels(labels: DataFrame) -> DataFrame:
    """Rows that people marked as good and not toxic."""
    return labels.where("quality = 1 AND toxic = 0")
