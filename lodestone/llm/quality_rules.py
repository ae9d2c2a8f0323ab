"""Quality rules with risk-controlled thresholds.

Each rule bounds one measure of a text, by one of a grid of cutoffs. The labelled good texts of a stratum are dealt into two halves by the
hash of their id. On the first half the cutoffs of all rules are put into one order, those that turn away
the fewest good texts first. On the second half, the holdout, they are taken on in that order, and after each step an
exact binomial test of the joint verdict must reject "more than RISK of good texts are turned away by the rules so far" (the chance of so few rejections
under that rate is at most the level). Testing stops at the first step that fails; as the order is
fixed before the holdout is seen, this controls the error along it. The level is CONFIDENCE's complement divided by the number of strata (Bonferroni), so with
CONFIDENCE no stratum loses more than RISK of its good texts to its certified cutoffs, all rules together.

One pass over the texts gives the measures, which are kept in the shared folder; labels are joined to
measures, not to texts. A labelled text counts by the first cutoff of each rule that it is over, so a stratum comes to one row for each
such combination, whose number the grids bound. The cutoffs are joined to the measures. A stratum without certified cutoffs of its own has the base rules only.

Results in special cases: a null or empty text has no words and fails the base rules; very long texts are
measured whole; repeated rows each get their row; a null id has no label; a null stratum is a stratum of its own; an empty table gives an
empty result; columns other than those named are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm._common import arrow_map, blocks, checkpointed, raw, words

RISK, CONFIDENCE = 0.01, 0.95
WINDOW = 8
#: Strata whose cutoffs are broadcast; more are joined by a shuffle.
BROADCAST = 100_000

#: Rule: (measure, cutoffs from the loosest to the tightest); a text above the cutoff is turned away.
RULES = {
    "symbols": ("100 * n_symbols / greatest(n_words, 1)", [200, 150, 100, 80, 60, 50, 40, 30, 20, 15, 10, 5]),
    "duplicate_lines": ("100 * n_dup_lines / greatest(n_lines, 1)", [90, 80, 70, 60, 50, 40, 30, 20, 10]),
    "repeats": ("100 * n_repeat_words / greatest(n_words, 1)", [28, 25, 20, 15, 10, 5]),
    "long_words": ("word_chars / greatest(n_words, 1)", [40, 30, 25, 20, 15, 12, 10]),
    "bangs": ("100 * n_bangs / greatest(n_words, 1)", [200, 150, 100, 80, 60, 50, 40, 30, 20, 10]),
}

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_SPACE = b" \t\n\v\f\r"


def repeated(codes: np.ndarray, at: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Words of each text that lie in a window found twice or more in that text."""
    sizes = np.diff(at)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    room = at[1:][owner] - np.arange(len(codes))  # words from here to the text's end
    number, width = codes.astype(np.int64), 1
    while width < window:  # numbers of runs twice as long, exact
        ahead = np.zeros_like(number)
        ahead[:-width] = number[width:]
        _, number = np.unique(number * (int(number.max(initial=0)) + 1) + ahead, return_inverse=True)
        width *= 2
    starts = np.flatnonzero(room >= window)
    if not len(starts):
        return np.zeros(len(sizes), dtype=np.int64)
    key = owner[starts] * np.int64(number.max() + 1) + number[starts]
    _, back, count = np.unique(key, return_inverse=True, return_counts=True)
    twice = starts[count[back] > 1]
    change = np.zeros(len(codes) + 1, dtype=np.int64)
    np.add.at(change, twice, 1)
    np.add.at(change, twice + window, -1)
    covered = np.cumsum(change[:-1]) > 0
    return np.bincount(owner[covered], minlength=len(sizes)).astype(np.int64)


def line_counts(text: str) -> tuple[int, int]:
    """Lines with a word, and those equal to an earlier line."""
    lines = [x for x in text.encode().split(b"\n") if x.strip(_SPACE)]
    return len(lines), len(lines) - len(set(lines))


MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_bangs"]


def measures(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """Per row: the id, ``stratum`` and the counts MEASURES of the whole text (long)."""

    def run(batches):
        for block in blocks(batches, 1):
            texts = block.column(1)
            codes, at, _ = words(texts)
            data, ends = raw(texts)
            total = lambda mask, ends=ends: np.diff(np.concatenate(([0], np.cumsum(mask)))[ends])
            lines = np.array([line_counts(t) for t in texts.to_pylist()], dtype=np.int64).reshape(-1, 2)
            space = (data == 32) | ((data >= 9) & (data <= 13))
            columns = [np.diff(at), total(((data & 0xC0) != 0x80) & ~space), total(_SYMBOL[data]), lines[:, 1], repeated(codes, at), lines[:, 0], total(data == 33)]
            yield pa.RecordBatch.from_arrays([block.column(0), block.column(2), *(pa.array(c.astype(np.int64)) for c in columns)], names=[id_col, "stratum", *MEASURES])

    kind = df.schema[id_col].dataType.simpleString()
    return arrow_map(df, [id_col, text_col, F.col(stratum_col).cast("string").alias("stratum")], run, f"{id_col} {kind}, stratum string, " + ", ".join(f"{m} long" for m in MEASURES))


def tail(n: int, k: int, risk: float) -> float:
    """P(Binomial(n, risk) <= k), exact."""
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(risk) + (n - i) * math.log1p(-risk) for i in range(k + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * sum(math.exp(x - top) for x in logs))


def order_of(profiles: list[tuple[int, ...]], counts: list[int]) -> list[tuple[str, int]]:
    """All (rule, place in its grid), those first that turn away the fewest texts. ``profiles`` have for each rule the first place whose cutoff the text is over."""
    away = {(rule, k): sum(n for p, n in zip(profiles, counts, strict=True) if p[r] <= k) for r, (rule, (_, grid)) in enumerate(RULES.items()) for k in range(len(grid))}
    return sorted(away, key=lambda step: (away[step], step[1], step[0]))  # counts grow along a grid, so its looser cutoffs come first


def certified(steps: list[tuple[str, int]], profiles: list[tuple[int, ...]], counts: list[int], level: float, risk: float = RISK) -> dict[str, int]:
    """The tightest certified place of each rule's grid, on holdout texts given as in ``order_of``."""
    place = {step: i for i, step in enumerate(steps)}
    fresh = [0] * len(steps)  # texts that a step is the first to turn away
    for p, n in zip(profiles, counts, strict=True):
        first = min((place[rule, p[r]] for r, (rule, (_, grid)) in enumerate(RULES.items()) if p[r] < len(grid)), default=None)
        if first is not None:
            fresh[first] += n
    out, away, n = {}, 0, sum(counts)
    for (rule, k), more in zip(steps, fresh, strict=True):
        away += more
        if not n or away > risk * n or tail(n, away, risk) > level:
            break
        out[rule] = k
    return out


def cutoffs(measured: DataFrame, good: DataFrame, id_col: str = "doc_id", risk: float = RISK, confidence: float = CONFIDENCE) -> DataFrame:
    """Per labelled stratum: ``stratum`` and the certified cutoff of each rule (null: none). ``good`` has the ids of good labelled texts.

    Texts that the base rules turn away anyway are no evidence.
    """
    labelled = measured.where(~F.col("base_failed")).join(good.select(id_col).where(F.col(id_col).isNotNull()).distinct(), id_col)
    over = [sum((F.lit(c) >= F.expr(m)).cast("int") for c in grid).alias(rule) for rule, (m, grid) in RULES.items()]  # cutoffs descend
    half = (F.substring(F.md5(F.col(id_col).cast("string")), 1, 1) >= "8").cast("int").alias("half")
    profiles = checkpointed(labelled.select("stratum", half, *over).groupBy("stratum", "half", *RULES).agg(F.count(F.lit(1)).alias("n")))
    level = (1 - confidence) / max(1, profiles.select("stratum").distinct().count())

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        halves = [([tuple(r[rule] for rule in RULES) for r in rows if r["half"] == h], [r["n"] for r in rows if r["half"] == h]) for h in (0, 1)]
        found = certified(order_of(*halves[0]), *halves[1], level, risk)
        return pa.table([table.column("stratum").slice(0, 1), *(pa.array([RULES[rule][1][found[rule]] if rule in found else None], pa.int64()) for rule in RULES)], names=["stratum", *RULES])

    return profiles.groupBy("stratum").applyInArrow(run, "stratum string, " + ", ".join(f"{rule} long" for rule in RULES))


def judge(df: DataFrame, good: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """Per row: the id, MEASURES, ``base_failed`` and ``kept``. ``good`` has the ids of good labelled texts."""
    measured = measures(df, id_col, text_col, stratum_col)
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    measured = checkpointed(measured.withColumn("base_failed", base))
    found = checkpointed(cutoffs(measured, good, id_col)).withColumnRenamed("stratum", "stratum_")
    verdict = F.lit(True)
    for rule, (measure, _) in RULES.items():
        verdict = verdict & ~F.coalesce(F.expr(measure) > F.col(rule), F.lit(False))
    joined = measured.join(F.broadcast(found) if found.count() <= BROADCAST else found, F.col("stratum").eqNullSafe(F.col("stratum_")), "left")
    return joined.select(id_col, *MEASURES[:5], "base_failed", (~F.col("base_failed") & verdict).alias("kept"))


def oracle(good: str = "SELECT doc_id FROM labels WHERE quality = 1") -> str:
    """DuckDB SQL for the rows of ``judge`` over ``documents``, with the ids of good texts from ``good``."""
    values = lambda table: " UNION ALL ".join(f"SELECT rid, lang, half, '{rule}' AS rule, {m} AS value FROM {table}" for rule, (m, _) in RULES.items())
    grid = ", ".join(f"('{rule}', {k}, {c})" for rule, (_, cut) in RULES.items() for k, c in enumerate(cut))
    word = r"[^\x20\x09-\x0D]"
    chance = f"list_sum(list_transform(range(0, away + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({RISK}) + (n - i) * ln(1 - {RISK}))))"
    turned = " OR ".join(f"coalesce({m} > cut_{rule}, false)" for rule, (m, _) in RULES.items())
    return f"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '{word}+') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{word}')) AS lines FROM t),
windows AS (SELECT rid, i, list_slice(w, i, i + {WINDOW - 1}) AS own FROM w, unnest(range(1, len(w) - {WINDOW - 2})) r(i)),
twice AS (SELECT rid, i FROM windows QUALIFY count(*) OVER (PARTITION BY rid, own) > 1),
covered AS (SELECT rid, count(DISTINCT i + k) AS n FROM twice, range({WINDOW}) r(k) GROUP BY rid),
measured AS (SELECT rid, doc_id, lang, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines, length(regexp_replace(text, '[^!]', '', 'g'))::BIGINT AS n_bangs
  FROM w LEFT JOIN covered USING (rid)),
m AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM measured),
labelled AS (SELECT m.*, (md5(doc_id::VARCHAR)[1] >= '8')::INT AS half FROM m WHERE NOT base_failed AND doc_id IN ({good})),
v AS ({values("labelled")}),
grid(rule, k, c) AS (VALUES {grid}),
strata AS (SELECT lang, count(*) FILTER (half = 1) AS n, count(*) OVER () AS strata FROM labelled GROUP BY lang),
steps AS (SELECT s.lang, n, strata, g.rule, g.k, g.c, row_number() OVER (PARTITION BY s.lang ORDER BY count(v.rid), g.k, g.rule) AS step
  FROM strata s CROSS JOIN grid g LEFT JOIN v ON v.lang IS NOT DISTINCT FROM s.lang AND v.rule = g.rule AND v.half = 0 AND v.value > g.c GROUP BY s.lang, n, strata, g.rule, g.k, g.c),
firsts AS (SELECT v.lang, rid, min(step) AS step FROM v JOIN steps s ON v.lang IS NOT DISTINCT FROM s.lang AND v.rule = s.rule AND v.value > s.c WHERE half = 1 GROUP BY v.lang, rid),
fresh AS (SELECT lang, step, count(*) AS more FROM firsts GROUP BY lang, step),
tried AS (SELECT s.*, sum(coalesce(more, 0)) OVER (PARTITION BY s.lang ORDER BY s.step)::BIGINT AS away FROM steps s LEFT JOIN fresh f ON s.lang IS NOT DISTINCT FROM f.lang AND s.step = f.step),
tested AS (SELECT *, n > 0 AND away <= {RISK} * n AND {chance} <= {1 - CONFIDENCE} / strata AS holds FROM tried),
passed AS (SELECT *, bool_and(holds) OVER (PARTITION BY lang ORDER BY step) AS certified FROM tested),
cut AS (SELECT lang, {", ".join(f"min(c) FILTER (rule = '{rule}') AS cut_{rule}" for rule in RULES)} FROM passed WHERE certified GROUP BY lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({turned}) AS kept
FROM m LEFT JOIN cut ON m.lang IS NOT DISTINCT FROM cut.lang"""
