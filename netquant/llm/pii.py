"""Personal data by candidate gradient boosting, with DataFrame functions only.

High-recall patterns propose spans that may overlap. Format and context features of each candidate go through boosted trees, which are
evaluated as column expressions; spans whose calibrated probability reaches the threshold of their kind are redacted. Spans of the four base
kinds that pass their checks always stay. All candidates of a text are an array in its row: nothing is exploded or shuffled.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netquant.llm.common import text_of

#: The base kinds in the order of their listing. Possessive forms of the base patterns that find the same leftmost matches
#: without trying every sign of a long run. Groups that repeat are possessive too: Java repeats those in a loop, others by recursion, which long texts end.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Kinds that the method adds.
MORE = {
    "national_id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "local_phone": r"(?<![0-9+(-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])",
    "hidden_email": r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]++ ?[\[(] ?at ?[\])] ?[a-z0-9-]++(?: ?(?:\.|[\[(] ?dot ?[\])]) ?[a-z0-9-]++)++",
    "secret": r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])(?=[0-9_-]*+[A-Za-z])[A-Za-z0-9_-]{20,}+(?![A-Za-z0-9_-])",
}
KINDS = [*BASE, *MORE]
IP_PARTS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})(?:\.|$)){4}$"
CUES = r"(?:token|key|secret|passw|pwd|api|auth|ssn|social|phone|tel|call|mail|card|contact|host|addr|ip)[^\p{L}\p{N}]{0,6}$"
CONTEXT = 24
#: Items of a text that are gathered in one array at a time.
RUN = 256

FEATURES = [
    "kind", "length", "digits", "letters", "upper", "signs", "blanks", "distinct", "luhn", "ip_parts", "hex", "cue",
    "before_letter", "before_digit", "after_letter", "after_digit",
]


class Booster(NamedTuple):
    #: Each tree: feature, limit, left, right; a leaf is its value.
    trees: list
    start: float
    #: Slope and constant that turn a margin into a calibrated log-odds.
    slope: float
    shift: float
    #: Least probability for each kind; a kind without one is never selected.
    thresholds: dict[str, float]


def in_runs(items: Column, out_type: str, step: Callable[[Column, Column], Column]) -> Column:
    """Results of a scan from left to right: ``step(at, item)`` gives the next position and the item's result.

    Arrays grow by copying, so results are gathered in runs of ``RUN``: a text of n items costs n copies of a run, not n of the whole.
    """
    # Bound to a variable, as a column would be worked out again for each run.
    cut = lambda x: F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / RUN).cast("int")), lambda r: F.slice(x, r * RUN + 1, F.lit(RUN)))
    runs = F.get(F.transform(F.array(items), cut), F.lit(0))
    start = lambda at, kind: F.struct(at.alias("at"), F.array().cast(kind).alias("out"))

    def inner(state: Column, item: Column) -> Column:
        made = F.transform(F.array(step(state["at"], item)), lambda s: F.struct(s["at"].alias("at"), F.concat(state["out"], F.array(s["value"])).alias("out")))
        return F.get(made, F.lit(0))

    def outer(state: Column, run: Column) -> Column:
        one = F.aggregate(run, start(state["at"], f"array<{out_type}>"), inner)
        return F.get(F.transform(F.array(one), lambda s: F.struct(s["at"].alias("at"), F.concat(state["out"], F.array(s["out"])).alias("out"))), F.lit(0))

    return F.aggregate(runs, start(F.lit(0), f"array<array<{out_type}>>"), outer)


def _spans(text: Column, kind: str, pattern: str) -> Column:
    """Matches of a pattern as structs with code point positions, end exclusive."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)

    def step(at: Column, pair: Column) -> Column:
        start = at + F.length(pair["gap"])
        end = start + F.length(pair["value"])
        span = F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), pair["value"].alias("value"))
        return F.struct(end.alias("at"), span.alias("value"))

    pairs = F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("gap"), found.alias("value"))
    return F.when(F.size(found) > 0, F.flatten(in_runs(pairs, SPAN, step)["out"])).otherwise(F.array().cast(f"array<{SPAN}>"))


SPAN = "struct<kind:string,start:int,end:int,value:string>"


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the digits of the value pass the check digit rule."""
    digits = F.split(F.reverse(digits_of(value)), "")

    def part(d: Column, i: Column) -> Column:
        n = d.try_cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return F.when(n > 9, n - 9).otherwise(n)

    return F.aggregate(F.transform(digits, part), F.lit(0), lambda a, b: a + F.coalesce(b, F.lit(0))) % 10 == 0


def _checked(span: Column) -> Column:
    """Whether a candidate of a base kind passes its check."""
    value, n = span["value"], F.length(digits_of(span["value"]))
    return (
        F.when(span["kind"] == "email", F.lit(True))
        .when(span["kind"] == "ip", value.rlike(IP_PARTS))
        .when(span["kind"] == "card", n.between(13, 19) & luhn(value))
        .when(span["kind"] == "phone", n.between(9, 15))
        .otherwise(F.lit(False))
    )


def _featured(text: Column, spans: Column) -> Column:
    """Spans with their features as doubles."""

    def features(s: Column) -> Column:
        value = s["value"]
        left = F.substring(text, F.greatest(s["start"] - CONTEXT + 1, F.lit(1)), F.least(s["start"], F.lit(CONTEXT)))
        right = F.substring(text, s["end"] + 1, F.lit(1))
        count = lambda pattern: F.length(F.regexp_replace(value, pattern, ""))
        columns = {
            "kind": F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]),
            "length": F.length(value),
            "digits": count("[^0-9]"),
            "letters": count("[^A-Za-z]"),
            "upper": count("[^A-Z]"),
            "signs": count("[A-Za-z0-9 ]"),
            "blanks": count("[^ ]"),
            "distinct": F.size(F.array_distinct(F.split(F.lower(value), ""))),
            "luhn": luhn(value).cast("int"),
            "ip_parts": value.rlike(IP_PARTS).cast("int"),
            "hex": F.lower(value).rlike("^[0-9a-f]+$").cast("int"),
            "cue": F.lower(left).rlike(CUES).cast("int"),
            "before_letter": left.rlike(r"\p{L}$").cast("int"),
            "before_digit": left.rlike("[0-9]$").cast("int"),
            "after_letter": right.rlike(r"^\p{L}").cast("int"),
            "after_digit": right.rlike("^[0-9]").cast("int"),
        }
        made = [columns[f].cast("double").alias(f) for f in FEATURES]
        return F.struct(*(s[c].alias(f"span_{c}") for c in ("kind", "start", "end", "value")), _checked(s).alias("checked"), *made)

    return F.transform(spans, features)


def candidates(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``candidates``: all proposed spans of all kinds with their features."""
    text = text_of(text_col)
    found = docs.withColumns({f"_{kind}": _spans(text, kind, pattern) for kind, pattern in (BASE | MORE).items()})
    spans = found.withColumn("_spans", F.concat(*(F.col(f"_{k}") for k in KINDS))).drop(*(f"_{k}" for k in KINDS))
    return spans.withColumn("candidates", _featured(text, F.col("_spans"))).drop("_spans")


def _silver(c: Column) -> Column:
    """Label of a candidate in training: its kind's own check, or a telling context."""
    kind = c["span_kind"]
    return (
        F.when(kind.isin(*BASE), c["checked"])
        .when(kind == "national_id", ~c["span_value"].rlike("^(?:000|666|9)|-00-|-0000$"))
        .when(kind == "local_phone", (c["cue"] == 1) | c["span_value"].startswith("("))
        .when(kind == "hidden_email", F.lit(True))
        .otherwise((c["cue"] == 1) | (c["hex"] == 1))
    )


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bound: int = 20_000, rows: int = 50_000) -> Booster:
    """Boosted trees from the candidates of at most ``bound`` documents and ``rows`` spans, both taken in hash order.

    No labelled spans exist, so candidates that pass their kind's check or stand after a cue are positive, all others negative; a
    fifth of them calibrates the probabilities and sets the thresholds. With fewer than two candidates, and for kinds that the fifth doesn't hold, nothing is added to the base spans.
    """
    ids = docs.select(F.col(id_col).alias("id")).dropna().distinct().orderBy(F.xxhash64("id"), "id").limit(bound)
    # The sample is small by its bound.
    sample = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).join(F.broadcast(ids), "id", "left_semi")
    one = candidates(sample).select("id", F.explode("candidates").alias("c"))
    fold = F.pmod(F.xxhash64("id", "c.span_start"), F.lit(5)).alias("fold")
    flat = one.select(*(F.col("c")[f].alias(f) for f in FEATURES), _silver(F.col("c")).cast("int").alias("y"), fold, F.xxhash64("id", "c").alias("h"))
    got = flat.orderBy("h").limit(rows).drop("h").collect()
    nothing = Booster([], 0.0, 1.0, 0.0, {})
    if not got:
        return nothing
    data = np.array([tuple(r) for r in got], float)
    x, y, held = data[:, :-2], data[:, -2], data[:, -1] == 0
    if held.all() or not held.any():
        held = np.arange(len(y)) % 5 == 0
    if held.all() or not held.any():
        return nothing
    trees, start = boost(x[~held], y[~held])
    margin = start + sum((leaf_values(t, x[held]) for t in trees), np.zeros(int(held.sum())))
    slope, shift = calibrate(margin, y[held])
    p = 1 / (1 + np.exp(-np.clip(slope * margin + shift, -500, 500)))
    kinds = x[held][:, 0]
    thresholds = {kind: least_probability(p[kinds == k + 1], y[held][kinds == k + 1]) for k, kind in enumerate(KINDS)}
    return Booster(trees, start, slope, shift, thresholds)


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 24, depth: int = 3, rate: float = 0.3, least: int = 4) -> tuple[list, float]:
    """Gradient boosting of regression trees on the logistic loss; leaves take Newton steps."""
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    start = float(np.log(share / (1 - share)))
    margin, trees = np.full(len(y), start), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        tree = _grow(x, y - p, p * (1 - p), depth, rate, least)
        trees.append(tree)
        margin += leaf_values(tree, x)
    return trees, start


def _grow(x, g, h, depth, rate, least):
    value = float(rate * g.sum() / (h.sum() + 1.0))
    if depth == 0 or len(g) < 2 * least:
        return value
    best, gain = None, 1e-6
    whole = g.sum() ** 2 / (h.sum() + 1.0)
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, gs, hs = x[order, f], np.cumsum(g[order]), np.cumsum(h[order])
        at = np.flatnonzero(v[1:] > v[:-1])
        at = at[(at + 1 >= least) & (len(g) - at - 1 >= least)]
        if not len(at):
            continue
        gains = gs[at] ** 2 / (hs[at] + 1) + (gs[-1] - gs[at]) ** 2 / (hs[-1] - hs[at] + 1) - whole
        k = int(gains.argmax())
        if gains[k] > gain:
            gain, best = gains[k], (f, float((v[at[k]] + v[at[k] + 1]) / 2))
    if best is None:
        return value
    f, limit = best
    low = x[:, f] <= limit
    return (f, limit, _grow(x[low], g[low], h[low], depth - 1, rate, least), _grow(x[~low], g[~low], h[~low], depth - 1, rate, least))


def leaf_values(tree, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, float):
        return np.full(len(x), tree)
    f, limit, low, high = tree
    return np.where(x[:, f] <= limit, leaf_values(low, x), leaf_values(high, x))


def calibrate(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and constant of a logistic fit of labels on margins, with smoothed targets."""
    pos, neg = y.sum(), len(y) - y.sum()
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -500, 500)))
        w = p * (1 - p) + 1e-9
        g = np.array([((p - target) * margin).sum() + 1e-3 * (a - 1), (p - target).sum()])
        curve = np.array([[(w * margin**2).sum() + 1e-3, (w * margin).sum()], [(w * margin).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(curve, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def least_probability(p: np.ndarray, y: np.ndarray, precision: float = 0.95) -> float:
    """Least threshold, at 0.5 or above, from which on the given share of selected candidates is positive; 2 if there is none."""
    for t in np.unique(np.concatenate([[0.5], p[p >= 0.5]])):
        chosen = p >= t
        if chosen.any() and y[chosen].mean() >= precision:
            return float(t)
    return 2.0


def probability(c: Column, model: Booster) -> Column:
    """Calibrated probability of a candidate, as nested conditions."""

    def value(tree) -> Column:
        if isinstance(tree, float):
            return F.lit(tree)
        f, limit, low, high = tree
        return F.when(c[FEATURES[f]] <= limit, value(low)).otherwise(value(high))

    margin = F.lit(model.start)
    for tree in model.trees:
        margin = margin + value(tree)
    return 1 / (1 + F.exp(-(margin * model.slope + model.shift)))


def find(docs: DataFrame, model: Booster, text_col: str = "text") -> DataFrame:
    """``docs`` with ``spans``: array of (kind, start, end, value, p, base), by kind as listed, then start.

    Base spans always stay. Added spans reach their kind's threshold, overlap no base span and no added span of higher probability (of equal ones
    the first stays). Positions are code points, end exclusive. Null text counts as empty and has an empty array; columns named ``spans``
    or ``candidates`` are replaced, all others, repeated rows and nulls are kept.
    """
    plain = docs.drop("spans", "candidates")
    with_candidates = candidates(plain, text_col)
    c = F.col("candidates")
    as_span = lambda x, p, base: F.struct(
        x["span_kind"].alias("kind"), x["span_start"].alias("start"), x["span_end"].alias("end"), x["span_value"].alias("value"), p.alias("p"), F.lit(base).alias("base")
    )
    kept = F.transform(F.filter(c, lambda x: x["checked"]), lambda x: as_span(x, F.lit(1.0), True))
    limit = lambda x: F.coalesce(*(F.when(x["span_kind"] == k, F.lit(t)) for k, t in model.thresholds.items()), F.lit(2.0))
    scored = F.transform(F.filter(c, lambda x: x["span_kind"].isin(*MORE)), lambda x: F.struct(as_span(x, probability(x, model), False).alias("s"), limit(x).alias("limit")))
    chosen = F.transform(F.filter(F.col("_scored"), lambda x: x["s"]["p"] >= x["limit"]), lambda x: x["s"])
    overlap = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"])
    better = lambda a, b: (b["p"] > a["p"]) | ((b["p"] == a["p"]) & (F.struct(b["start"], b["end"], b["kind"]) < F.struct(a["start"], a["end"], a["kind"])))
    free = F.filter(
        F.col("_chosen"),
        lambda a: ~F.exists(F.col("_kept"), lambda b: overlap(a, b)) & ~F.exists(F.col("_chosen"), lambda b: overlap(a, b) & better(a, b)),
    )
    place = lambda s: F.array_position(F.array(*map(F.lit, KINDS)), s["kind"])
    keyed = F.transform(F.concat(F.col("_kept"), free), lambda s: F.struct(place(s).alias("o"), s["start"].alias("a"), s.alias("s")))
    return (
        with_candidates.withColumn("_kept", kept)
        .withColumn("_scored", scored)
        .drop("candidates")
        .withColumn("_chosen", chosen)
        .withColumn("spans", F.transform(F.array_sort(keyed), lambda x: x["s"]))
        .drop("_kept", "_scored", "_chosen")
    )


def listed(spans: Column, keep: Callable[[Column], Column] | None = None) -> Column:
    """``kind:start:end`` of spans, joined by commas."""
    shown = F.filter(spans, keep) if keep else spans
    return F.array_join(F.transform(shown, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; spans that overlap are replaced as one, named by the first."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def step(at: Column, s: Column) -> Column:
        gap = F.substring(text, at + 1, s["start"] - at)
        part = F.when(s["start"] < at, F.lit("")).otherwise(F.concat(gap, F.lit("["), F.upper(s["kind"]), F.lit("]")))
        return F.struct(F.greatest(at, s["end"]).alias("at"), part.alias("value"))

    parts = in_runs(ordered, "string", step)
    whole = F.transform(F.array(parts), lambda p: F.concat(F.array_join(F.flatten(p["out"]), ""), F.substring(text, p["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, F.get(whole, F.lit(0))).otherwise(text)


def redact(docs: DataFrame, model: Booster, text_col: str = "text") -> DataFrame:
    """``docs`` with the spans of ``text_col`` replaced; null text stays null, and ``n_chars`` follows where it is a column."""
    found = find(docs, model, text_col)
    out = found.withColumn(text_col, redacted(F.col(text_col), F.col("spans"))).drop("spans")
    if "n_chars" in docs.columns:
        changed = F.when(F.col(text_col).isNotNull(), F.length(text_col)).cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.coalesce(changed, F.col("n_chars")))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns if c in out.columns))
