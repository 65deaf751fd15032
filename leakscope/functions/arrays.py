"""Row-local array expressions: no shuffle, no Python workers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def words(text: Column) -> Column:
    """Lower-case word tokens; runs of white space separate."""
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")


def array_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def array_mean(values: Column) -> Column:
    return F.try_divide(array_sum(values), F.size(values).cast("double"))


def array_stddev_pop(values: Column) -> Column:
    mean = array_mean(values)
    square = F.aggregate(
        F.transform(values, lambda x: (x - mean) * (x - mean)), F.lit(0.0), lambda a, x: a + x
    )
    return F.sqrt(F.try_divide(square, F.size(values).cast("double")))


# -- lowest-k% token probability -------------------------------------------------


def lowest_k_count(values: Column, k: Column) -> Column:
    return (F.size(values) * (k / F.lit(100.0))).cast("int")


def mink_sorted(ordered: Column, k: Column) -> Column:
    """Mean of the lowest k percent of an ascending array, null when that is no token."""
    m = lowest_k_count(ordered, k)
    total = array_sum(F.slice(ordered, F.lit(1), m))
    return F.try_divide(total, m.cast("double"))


def mink(values: Column, k: Column) -> Column:
    return mink_sorted(F.array_sort(values), k)


# -- n-grams ----------------------------------------------------------------------


def grams(tokens: Column, n: int) -> Column:
    """All n-token windows, joined by one blank."""
    if n == 1:
        return tokens
    if n <= 3:
        # Neighbours by position are cheaper than a slice per window.
        return F.transform(
            F.slice(tokens, F.lit(n), F.size(tokens)),
            lambda w, i: F.concat_ws(" ", *[F.get(tokens, i + j) for j in range(n - 1)], w),
        )
    last = F.size(tokens) - F.lit(n - 1)
    starts = F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(
        F.array().cast("array<int>")
    )
    return F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, n), " "))


def target_ngrams(tokens: Column, starts: Column, n: Column | int) -> Column:
    width = F.lit(n) if isinstance(n, int) else n
    return F.transform(starts, lambda s: F.slice(tokens, s + 1, width))


def ngram_accuracy(targets: Column, predictions: Column) -> Column:
    """Share of equal pairs, position by position, cut to the shorter; 0 without pairs."""
    pairs = F.least(F.size(targets), F.size(predictions))
    hits = F.size(
        F.filter(
            F.sequence(F.lit(0), F.greatest(pairs, F.lit(1)) - 1),
            lambda i: F.get(targets, i) == F.get(predictions, i),
        )
    )
    return F.when(pairs > 0, hits / pairs.cast("double")).otherwise(F.lit(0.0))


def ngram_loglike(scores: Column, starts: Column, n: Column | int) -> Column:
    width = F.lit(n) if isinstance(n, int) else n
    return F.transform(starts, lambda s: array_sum(F.slice(scores, s + 1, width)))


def problem_only(scores: Column, problem_length: Column) -> Column:
    return F.slice(scores, F.lit(1), problem_length)


def start_offset(length: Column, n: Column, offset: int) -> Column:
    """The offset, shortened for texts that do not reach past offset + n."""
    short = F.greatest(
        F.lit(1), F.least(F.lit(offset), F.floor(length / F.lit(3)).cast("int"))
    )
    return F.when(length <= n + F.lit(offset), short).otherwise(F.lit(offset))


def start_points_even(length: Column, n: Column | int, count: int, offset: int) -> Column:
    """Evenly spread start positions; null where the text is too short."""
    width = F.lit(n) if isinstance(n, int) else n
    low = start_offset(length, width, offset)
    room = length - low - width
    points = F.least(F.lit(count), room)
    step = F.try_divide((room - 1).cast("double"), (points - 1).cast("double"))
    spread = F.transform(
        F.sequence(F.lit(0), points - 1),
        lambda i: low + F.when(i == points - 1, room - 1).otherwise((i * step).cast("int")),
    )
    middle = F.array(low + F.floor(room / F.lit(2)).cast("int"))
    return F.when(room > 0, F.when(points == 1, middle).otherwise(spread))


def start_points_random(
    length: Column, n: Column | int, count: int, offset: int, seed: int, key: Column
) -> Column:
    """Start positions drawn without replacement, in md5 order of (seed, key, position)."""
    width = F.lit(n) if isinstance(n, int) else n
    low = start_offset(length, width, offset)
    high = length - width - 1
    drawn = F.array_sort(
        F.transform(
            F.sequence(low, high),
            lambda p: F.struct(
                F.md5(
                    F.concat_ws("|", F.lit(str(seed)), key.cast("string"), p.cast("string"))
                ).alias("h"),
                p.alias("p"),
            ),
        )
    )
    return F.when(
        high >= low, F.transform(F.slice(drawn, 1, count), lambda s: s["p"])
    )


# -- generated sequences ------------------------------------------------------------


def truncate_ids(ids: Column, end: Column) -> Column:
    """Cut after the first end token, keeping it."""
    at = F.array_position(ids, end)
    return F.when(at > 0, F.slice(ids, F.lit(1), at.cast("int"))).otherwise(ids)


def truncate_samples(samples: Column, end: Column) -> Column:
    return F.transform(samples, lambda ids: truncate_ids(ids, end))


def max_length(greedy: Column, samples: Column) -> Column:
    longest = F.aggregate(samples, F.lit(0), lambda acc, s: F.greatest(acc, F.size(s)))
    return F.greatest(F.size(greedy), longest)


def _one_char(position: Column) -> Column:
    """A distinct code point per position, leaving out surrogates and the byte order mark."""
    point = position.cast("int") + 255
    point = F.when(point >= 0xD800, point + 0x2700).otherwise(point)
    return F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32")


def token_distance(a: Column, b: Column, limit: Column | None = None) -> Column:
    """Edit distance over tokens with unit costs.

    Each distinct token of the pair becomes one character, after which the built-in string
    distance counts tokens; a pair may have 1.1 million distinct tokens.  With ``limit`` only
    a band of that width around the diagonal is computed, and any larger distance is given
    as ``limit + 1``; a negative limit counts as 0.
    """
    known = F.array_distinct(F.concat(a, b))

    def encode(tokens: Column) -> Column:
        return F.array_join(
            F.transform(tokens, lambda t: _one_char(F.array_position(known, t))), ""
        )

    if limit is None:
        return F.levenshtein(encode(a), encode(b))
    bound = F.greatest(limit.cast("int"), F.lit(0))
    near = F.call_function("levenshtein", encode(a), encode(b), bound)
    return F.when(near < 0, bound + 1).otherwise(near)


def peak(distances: Column, longest: Column, alpha: Column) -> Column:
    """Share of samples whose distance is at most alpha times the longest output."""
    near = F.size(F.filter(distances, lambda d: d <= alpha * longest))
    return F.try_divide(near.cast("double"), F.size(distances).cast("double"))


def rho_star(distances: Column) -> Column:
    """Histogram of distances as shares."""
    total = F.size(distances).cast("double")
    return F.map_from_entries(
        F.transform(
            F.array_sort(F.array_distinct(distances)),
            lambda d: F.struct(
                d, F.size(F.filter(distances, lambda x: x == d)) / total
            ),
        )
    )
