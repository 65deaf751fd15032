"""Scores, labels and continuations from n-gram counts over a document corpus.

Corpus rows are exploded once per statistic, filtered by the keys the items
need while still in the scan stage, and counted with map-side combine, so hot
n-grams never meet in one task uncounted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakscope.functions.arrays import grams  # noqa: F401
from leakscope.functions.order import det_order
from leakscope.operators import packed
from leakscope.operators.bloom import bloom_filter
from leakscope.operators.ordering import top_k
from leakscope.session import fits_broadcast, settle

MU = 10.0


def places(df: DataFrame, *keep: str) -> DataFrame:
    """One row per word: ``tokens``, its place ``pos`` from 0 and ``word``.

    The words after it are read from ``tokens`` by position, so a window becomes text only
    where that is asked for, after rows that nobody wants are gone.
    """
    return df.select(*keep, "tokens", F.posexplode("tokens").alias("pos", "word"))


def _words_at(n: int, tokens: str = "tokens", pos: Column | str = "pos") -> list[Column]:
    at = F.col(pos) if isinstance(pos, str) else pos
    return [F.get(F.col(tokens), at + i) for i in range(n)]


def _window_key(n: int) -> Column:
    """64-bit hash of the n words from ``pos`` on, null where fewer are left."""
    return F.when(F.col("pos") + n <= F.size("tokens"), F.xxhash64(*_words_at(n)))


def _window_text(n: int) -> Column:
    return F.when(F.col("pos") + n <= F.size("tokens"), F.concat_ws(" ", *_words_at(n)))


def ngram_counts(docs: DataFrame, n: int) -> DataFrame:
    return (
        places(docs).select(_window_text(n).alias("gram"))
        .where(F.col("gram").isNotNull())
        .groupBy("gram")
        .agg(F.count(F.lit(1)).alias("n_seen"))
    )


def all_ngram_counts(docs: DataFrame, sizes: tuple[int, ...] = packed.SIZES) -> DataFrame:
    """Counts (n, gram, n_seen) of all windows of ``sizes`` words.

    All words are counted first: frequent ones get the numbers that stand for them in the
    shuffle, and the sum of all says into how many buckets windows are dealt. Words that are
    null or hold a blank, which no split at white space gives, make windows of other words the
    same text: then, and for longer windows, the text itself is counted.
    """
    if not sizes or not set(sizes) <= set(packed.SIZES) or len(set(sizes)) < len(sizes):
        return _text_counts(docs, sizes)
    seen = docs.select(F.explode("tokens").alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n_seen")).persist()
    try:
        odd = F.max(F.col("gram").isNull() | F.contains("gram", F.lit(" ")))
        classes = seen.groupBy("n_seen").agg(
            F.count(F.lit(1)).alias("words"), F.sum(F.octet_length("gram")).alias("bytes"), odd.alias("odd")
        ).collect()
        if any(r.odd for r in classes):
            return _text_counts(docs, sizes)
        common = packed.common_words(seen, [(r.n_seen, r.words, r.bytes) for r in classes])
    finally:
        seen.unpersist()
    n_words, n_bytes = (sum(r.n_seen * r[c] for r in classes) for c in ("words", "bytes"))
    least = 6 * docs.sparkSession.sparkContext.defaultParallelism
    buckets = packed.bucket_count(n_words, n_bytes, sizes, least)
    return packed.packed_counts(docs, F.col("tokens"), common, tuple(sorted(set(sizes))), buckets)


def _text_counts(docs: DataFrame, sizes: tuple[int, ...]) -> DataFrame:
    sized = [F.struct(F.lit(n).alias("n"), _window_text(n).alias("gram")) for n in sizes]
    return (
        places(docs).select(F.inline(F.array(*sized)))
        .where(F.col("gram").isNotNull())
        .groupBy("n", "gram")
        .agg(F.count(F.lit(1)).alias("n_seen"))
    )


def item_counts(
    items: DataFrame, docs: DataFrame, sizes: tuple[int, ...] = (2,), all_words: bool = True
) -> DataFrame:
    """Counts (gram, n_seen, n) of all corpus words and of the items' n-grams, in one corpus pass.

    Every document is exploded once, whatever the number of sizes. Hashes of the items' n-grams
    that fit are broadcast into the scan; beyond that a Bloom filter of them is. Only words
    and probable hits become text and reach the shuffle, already counted, and equality
    of the text decides after it. Without ``all_words`` the items' n-grams only are counted.
    """
    lengths = sorted(set(sizes) - ({1} if all_words else set()))
    if not lengths:
        return settle(ngram_counts(docs, 1).withColumn("n", F.lit(1)))

    def windows(df: DataFrame, lengths: list[int]) -> DataFrame:
        wide = places(df).select("tokens", "pos", F.explode(F.array(*[F.lit(n) for n in lengths])).alias("n"))
        key, text = (
            F.coalesce(*[F.when(F.col("n") == n, of(n)) for n in lengths]) for of in (_window_key, _window_text)
        )
        return wide.withColumn("own", key).where(F.col("own").isNotNull()).withColumn("gram", text)

    keys = settle(windows(items, lengths).select("n", "own", "gram").distinct())
    every = places(docs)
    words = [F.struct(F.lit(1).alias("n"), F.col("word").alias("gram"))] if all_words else []
    always = (F.col("n") == 1) if all_words else F.lit(False)
    if fits_broadcast(keys):
        for n in lengths:
            own = keys.where(F.col("n") == n).select("own", F.lit(True).alias(f"_hit{n}")).distinct()
            every = every.withColumn("own", _window_key(n)).join(F.broadcast(own), "own", "left").drop("own")
        hits = [F.struct(F.lit(n).alias("n"), F.when(F.col(f"_hit{n}"), _window_text(n)).alias("gram")) for n in lengths]
        if not all_words:
            every = every.where(" or ".join(f"_hit{n}" for n in lengths))
        probable = every.select(F.inline(F.array(*words, *hits))).where(F.col("gram").isNotNull())
    else:
        bloom = bloom_filter(keys.select("own").distinct(), F.col("own"))
        seen = windows(docs, [1, *lengths] if all_words else lengths)
        probable = bloom.probable(seen, F.col("own"), always if all_words else None)
    counted = settle(probable.groupBy("n", "gram").agg(F.count(F.lit(1)).alias("n_seen")))
    found = settle(counted.where(~always).join(keys.select("n", "gram"), ["n", "gram"], "left_semi"))
    both = counted.where(always).unionByName(found) if all_words else found
    return both.select("gram", "n_seen", "n")


def overlap_label(
    items: DataFrame, docs: DataFrame, n: int = 8, counts: DataFrame | None = None
) -> DataFrame:
    """LABEL_BINARY = 1 when any n-word window of the item is in the corpus.

    ``counts`` of ``item_counts`` with this n saves a pass over the corpus.
    """
    windows = items.select("ID", F.explode(grams(F.col("tokens"), n)).alias("gram"))
    counts = item_counts(items, docs, (n,), all_words=False) if counts is None else counts
    found = counts.where(F.col("n") == n).select("gram")
    hit = windows.join(found, "gram", "left_semi").select("ID").distinct()
    return (
        items.join(hit.withColumn("_hit", F.lit(1)), "ID", "left")
        .withColumn("LABEL_BINARY", F.coalesce("_hit", F.lit(0)))
        .withColumn("LABEL", F.when(F.col("LABEL_BINARY") == 1, "Conta").otherwise("Clean"))
        .drop("_hit")
    )


def token_scores(
    items: DataFrame, docs: DataFrame, mu: float = MU, counts: DataFrame | None = None
) -> DataFrame:
    """One row per scored token (ID, pos, prev, token, prob, log_like).

    P(w|h) = (c(h,w) + mu p1(w)) / (c(h) + mu), p1(w) = (c(w) + 1) / (N + V).
    The first token has no history and no score; pos counts from 0. ``counts`` of
    ``item_counts`` with pairs among its sizes saves a pass over the corpus.
    """
    counts = item_counts(items, docs) if counts is None else counts
    unigrams, pairs = (counts.where(F.col("n") == n).select("gram", "n_seen") for n in (1, 2))
    n_tokens, n_types = unigrams.agg(F.sum("n_seen"), F.count(F.lit(1))).first()
    spread = items.select("ID", "tokens", F.posexplode(F.slice("tokens", 2, 2**31 - 1)).alias("pos", "token")).selectExpr(
        "ID", "pos", "tokens[pos] as prev", "token", "concat_ws(' ', tokens[pos], token) as gram"
    )
    vocabulary = (
        spread.select(F.explode(F.array("prev", "token")).alias("gram"))
        .distinct()
        .join(unigrams, "gram", "left")
    )
    counted = (
        spread.join(pairs.withColumnRenamed("n_seen", "c_pair"), "gram", "left")
        .join(vocabulary.selectExpr("gram as prev", "n_seen as c_prev"), "prev", "left")
        .join(vocabulary.selectExpr("gram as token", "n_seen as c_token"), "token", "left")
    )
    base = f"((coalesce(c_token, 0) + 1.0D) / {float(n_tokens + n_types)!r}D)"
    prob = f"(coalesce(c_pair, 0) + {mu!r}D * {base}) / (coalesce(c_prev, 0) + {mu!r}D)"
    return counted.selectExpr("ID", "pos", "prev", "token", f"{prob} as prob").withColumn(
        "log_like", F.ln("prob")
    )


def token_data(items: DataFrame, scores: DataFrame) -> DataFrame:
    """Score arrays per item, in token order; the first token is left out."""
    ordered = scores.groupBy("ID").agg(
        F.array_sort(F.collect_list(F.struct("pos", "token", "prob", "log_like"))).alias("s")
    )
    return items.join(ordered, "ID").selectExpr(
        *[c for c in items.columns],
        "s.token as decoded_tokens",
        "s.prob as token_probs",
        "s.log_like as token_log_likes",
    )


def top_next(docs: DataFrame) -> DataFrame:
    """Most frequent follower of each word, ties to the smallest, with its share."""
    pairs = (
        docs.select(
            F.explode(
                F.expr(
                    "transform(slice(tokens, 2, size(tokens)), "
                    "(w, i) -> struct(tokens[i] as prev, w as token))"
                )
            ).alias("p")
        )
        .groupBy("p.prev", "p.token")
        .agg(F.count(F.lit(1)).alias("n_seen"))
    )
    return (
        pairs.groupBy("prev")
        .agg(
            F.min(F.struct((-F.col("n_seen")).alias("less"), "token")).alias("best"),
            F.sum("n_seen").alias("n_all"),
        )
        .selectExpr(
            "prev",
            "best.token as next_token",
            "-best.less as n_seen",
            "cast(-best.less as double) / n_all as prob",
        )
    )


def continuations(
    docs: DataFrame, contexts: DataFrame, c: int, n: int, samples: int, seed: int
) -> DataFrame:
    """Per context: the most common n following words and a sample of occurrences.

    ``contexts`` has a distinct ``context`` column. Returns greedy, an array of
    words, and samples, an array of word arrays in md5 order of (seed, doc, place).
    """
    # Near the end of a document fewer words follow; the last context has one.
    seen = places(docs, "doc_id").where(F.col("pos") + c < F.size("tokens"))
    asked = F.split("context", " ", -1)
    wanted = (
        contexts.select("context", asked.alias("tokens"), F.lit(0).alias("pos"))
        .where(F.size("tokens") == c)
        .select("context", _window_key(c).alias("own"))
    )
    hashes = wanted.select("own").distinct()
    if fits_broadcast(wanted):
        probable = seen.withColumn("own", _window_key(c)).join(F.broadcast(hashes), "own", "left_semi")
    else:
        # Only windows whose context may be wanted become text and are shuffled.
        own = _window_key(c)
        probable = bloom_filter(hashes, F.col("own")).probable(seen, own)
    kept = settle(
        probable.select(
            "doc_id",
            (F.col("pos") + 1).alias("at"),
            F.concat_ws(" ", *_words_at(c)).alias("context"),
            F.array_join(F.slice("tokens", F.col("pos") + c + 1, n), " ").alias("follow"),
        ).join(contexts, "context", "left_semi")
    )
    greedy = (
        kept.groupBy("context", "follow")
        .agg(F.count(F.lit(1)).alias("n_seen"))
        .groupBy("context")
        .agg(
            F.min(F.struct((-F.col("n_seen")).alias("less"), "follow")).alias("best"),
            F.sum("n_seen").alias("n_found"),
        )
        .selectExpr("context", "split(best.follow, ' ') as greedy", "n_found")
    )
    if samples <= 0:
        return greedy
    ranked = kept.withColumn("h", det_order(seed, "doc_id", "at"))
    drawn = (
        top_k(ranked, ["context"], ["h", "doc_id", "at"], samples)
        .groupBy("context")
        .agg(F.array_sort(F.collect_list(F.struct("h", "doc_id", "at", "follow"))).alias("s"))
        .selectExpr("context", "transform(s.follow, f -> split(f, ' ')) as samples")
    )
    return greedy.join(drawn, "context")


def item_starts(
    items: DataFrame, starts: Column, c: int, n: int
) -> DataFrame:
    """One row per (item, start point): the context before it and the words after it."""
    return (
        items.withColumn("start_points", starts)
        .select("ID", "tokens", F.posexplode("start_points").alias("slot", "start"))
        .where(F.col("start") >= c)
        .selectExpr(
            "ID",
            "slot",
            "start",
            f"array_join(slice(tokens, start - {c} + 1, {c}), ' ') as context",
            f"slice(tokens, start + 1, {n}) as target",
        )
    )


def predictions(
    items: DataFrame,
    docs: DataFrame,
    starts: Column,
    c: int = 2,
    n: int = 3,
    samples: int = 0,
    seed: int = 42,
) -> DataFrame:
    """Targets and corpus continuations at every start point.

    A context that the corpus never continues has an empty prediction.
    """
    at = item_starts(items, starts, c, n)
    found = continuations(docs, at.select("context").distinct(), c, n, samples, seed)
    return at.join(found, "context", "left").withColumn(
        "greedy", F.coalesce("greedy", F.array().cast("array<string>"))
    )


def ngram_generation(predicted: DataFrame, n: int) -> DataFrame:
    """Per item: target and predicted n-grams in start order, cut to n."""
    return (
        predicted.groupBy("ID")
        .agg(F.array_sort(F.collect_list(F.struct("slot", "start", "target", "greedy"))).alias("s"))
        .selectExpr(
            "ID",
            f"transform(s, x -> slice(x.target, 1, {n})) as TARGET_NGRAMS",
            f"transform(s, x -> slice(x.greedy, 1, {n})) as PREDICTED_NGRAMS",
            "s.start as START_POINTS",
        )
    )


def cdd_generation(
    items: DataFrame, docs: DataFrame, c: int = 2, n: int = 12, samples: int = 20, seed: int = 42
) -> DataFrame:
    """Greedy and sampled continuations of each problem; empty when the corpus has none."""
    ends = items.selectExpr(
        "ID",
        f"array_join(slice(tokens, greatest(problem_length - {c} + 1, 1), {c}), ' ') as context",
    )
    found = continuations(docs, ends.select("context").distinct(), c, n, samples, seed)
    empty = F.array().cast("array<string>")
    return ends.join(found, "context", "left").select(
        "ID",
        F.coalesce("greedy", empty).alias("GREEDY_IDS"),
        F.coalesce("samples", F.array().cast("array<array<string>>")).alias("SAMPLE_IDS"),
        F.expr(
            "greatest(size(coalesce(greedy, array())), coalesce(array_max(transform(samples, x -> size(x))), 0))"
        ).alias("MAX_LENGTH"),
    )
