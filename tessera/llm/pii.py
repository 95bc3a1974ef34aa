"""Personal data by weak supervision (operator 3), all in DataFrame functions.

1. Patterns propose candidate spans: the four base kinds, looser writings of phones and e-mails,
   and credentials.
2. Four labelers vote on each candidate (-1 no, 0 abstain, +1 yes): a strict-format regex, a
   gazetteer, the words before it, and its neighbours.
3. Spark counts the candidates by (kind, votes, shape).  That table has at most 5 * 3**4 * 8 rows
   whatever the input, so it alone goes to the driver, where expectation-maximisation estimates
   each labeler's reliability and a span classifier (logistic regression) learns from the
   posteriors.
4. The weights are compiled into the projection that makes the final spans.

Spans of the base rules always stay; the classifier adds spans that overlap none of them.  No row
is shuffled but the counts, so long or hot documents need no care.  Positions are code points,
the end exclusive.

Defined results: a null or empty text has no spans; repeated rows are each judged; an empty table
gives no rows and default weights; extra columns stay.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, written

KINDS = ("email", "ip", "card", "phone", "secret")
BASE_KINDS = KINDS[:4]

# Possessive groups keep Java's matcher from recursing on long runs.  A lookbehind lets a match
# begin only where a run of its characters does, or right after the match before (\G): the same
# leftmost matches, without rescanning a run from each of its characters.
_BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_LOOSE = {
    "email": r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]++\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]++(?:\x20?(?:[\[(]dot[\])]|\.)\x20?[A-Za-z0-9-]++)++",
    "phone": r"(?<![0-9A-Za-z+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z])",
    "secret": r"(?<![A-Za-z0-9])(?:(?:[Pp]assword|[Pp]asswd|[Pp]wd|[Tt]oken|[Ss]ecret|[Aa]pi[_-]?[Kk]ey)[\x20\t]{0,3}[=:][\x20\t]{0,3}\x22?[A-Za-z0-9_/+.-]{8,}+\x22?|AKIA[0-9A-Z]{16}(?![0-9A-Za-z]))",
}
_STRICT = {
    "email": r"^[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}$",
    "ip": r"^(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$",
    "card": r"^(?:[0-9]{4}[\x20-]?){3}[0-9]{1,7}$",
    "phone": r"^(?:\+[0-9]{1,3}[\x20.-]?)?\(?[0-9]{2,4}\)?[\x20.-]?[0-9]{3,4}[\x20.-]?[0-9]{3,4}$",
    "secret": r"(?:[=:].*[0-9].*|^AKIA[0-9A-Z]{16})$",
}
# Gazetteers as patterns on the span.
_GAZETTEER = {
    "email": r"(?i)\.(?:com|org|net|edu|gov|io|info|biz|eu|de|fr|es|uk|it|nl|ch|at|us|ca|au|jp|br|in)$",
    "ip": r"^(?!0\.|127\.|255\.|22[4-9]\.|23[0-9]\.)",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))",
    "phone": r"^(?:\+(?:1|3[0-9]|4[0-9]|5[0-9]|6[0-6]|7|8[1246]|9[0-8])|\(?[2-9][0-9]{2}\)?[\x20.-])",
    "secret": r"(?i)^(?:password|passwd|token|secret|api|AKIA)",
}
_CUES = {
    "email": r"(?i)(?:mail|contact|write|from|to|para|pour|an)[\x20:]*$",
    "ip": r"(?i)(?:ip|host|server|address|addr|from)[\x20:]*$",
    "card": r"(?i)(?:card|visa|amex|credit|carte|karte|tarjeta|number|no\.?)[\x20:]*$",
    "phone": r"(?i)(?:phone|tel|call|fax|mobile|t[eé]l[eé]fono?|anruf|number)[\x20.:]*$",
    "secret": r"(?i)(?:login|user|key|credential|auth|export)[\x20:,]*$",
}
CUE_CHARS = 24
LABELERS = 4
SHAPES = 8


def scan(items: Column, start: int, step: Callable[[Column, Column], tuple[Column, Column]], item_type: str) -> Column:
    """Running fold: [value of each item], where ``step(state, item)`` gives (new state, value).

    ``items`` must be a plain column, as it stands inside lambdas.  Two nested folds over slices
    of 256 keep the copying of results near linear.
    """
    size = 256

    def one(a, x):
        state, value = step(a["at"], x)
        return F.struct(F.concat(a["out"], F.array(value)).alias("out"), state.alias("at"))

    empty = F.array().cast(f"array<{item_type}>")

    def block(a, k):
        inner = F.aggregate(F.slice(items, k * size + 1, size), F.struct(empty.alias("out"), a["at"].alias("at")), one)
        return F.struct(F.concat(a["out"], F.array(inner["out"])).alias("out"), inner["at"].alias("at"))

    zero = F.struct(F.array().cast(f"array<array<{item_type}>>").alias("out"), F.lit(start).alias("at"))
    blocks = F.sequence(F.lit(0), F.floor((F.size(items) - 1) / size).cast("int"))
    return F.when(F.size(items) > 0, F.aggregate(blocks, zero, block, lambda a: F.flatten(a["out"]))).otherwise(empty)


_PLACED = "struct<start:int,end:int,m:string>"


#: What every match holds; a text without it isn't searched further.
_NEEDS = {
    ("email", True): lambda t: t.contains("@"),
    ("ip", True): lambda t: t.rlike(r"[0-9]\.[0-9]"),
    ("card", True): lambda t: t.rlike(r"[0-9][\x20-]?[0-9]"),
    ("phone", True): lambda t: t.contains("+"),
    ("email", False): lambda t: t.contains("at]") | t.contains("at)"),
    ("phone", False): lambda t: t.rlike(r"[0-9]{3}[\x20.-][0-9]{4}"),
    ("secret", False): lambda t: t.contains("=") | t.contains(":") | t.contains("AKIA"),
}


def _matches(kind: str, of_base: bool, text: Column) -> Column:
    """Each match with the length of the text between it and the one before."""
    pattern = (_BASE if of_base else _LOOSE)[kind]
    both = F.zip_with(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1), lambda m, p: F.struct(F.length(p).alias("gap"), m.alias("m")))
    found = F.filter(both, lambda x: x["m"].isNotNull())
    return F.when(_NEEDS[kind, of_base](text), found).otherwise(F.array().cast("array<struct<gap:int,m:string>>"))


def _placed(items: Column) -> Column:
    """Matches with their places: each begins after all gaps and matches before it."""

    def step(at, x):
        low = at + x["gap"]
        high = low + F.length(x["m"])
        return high, F.struct(low.alias("start"), high.alias("end"), x["m"].alias("m"))

    return scan(items, 0, step, _PLACED)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Luhn over the digits from the right, every second one doubled."""
    each = F.split(F.reverse(digits), "")
    value = lambda d, i: F.when(i % 2 == 0, d).otherwise(F.translate(d, "0123456789", "0246813579")).cast("int")
    total = F.aggregate(F.transform(F.filter(each, lambda d: d != ""), value), F.lit(0), lambda a, d: a + d)
    return total % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    n = F.length(_digits(m))
    if kind == "ip":
        return F.forall(F.split(m, "\\."), lambda p: F.coalesce(F.length(F.ltrim(p, F.lit("0"))) <= 3, F.lit(False)) & (F.coalesce(p.try_cast("int"), F.lit(999)) <= 255))
    if kind == "card":
        return n.between(12, 19) & _luhn(_digits(m))
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def _vote(yes: Column, no: Column | None = None) -> Column:
    """0 is no, 1 abstains, 2 is yes."""
    return F.when(yes, 2).when(F.lit(True) if no is None else no, 0).otherwise(1).cast("int")


_CANDIDATE = "struct<kind:int,start:int,end:int,base:boolean,v0:int,v1:int,v2:int,v3:int,shape:int>"


def _candidate(kind: str, of_base: bool, text: Column, x: Column) -> Column:
    m = x["m"]
    base = _valid(kind, m) if of_base else F.lit(False)
    before = F.substring(text, F.greatest(x["start"] - (CUE_CHARS - 1), F.lit(1)), F.least(x["start"], F.lit(CUE_CHARS)))
    left = F.substring(text, x["start"], F.when(x["start"] > 0, 1).otherwise(0))
    right = F.substring(text, x["end"] + 1, F.lit(1))
    digits = F.length(_digits(m))
    shape = F.when(digits == 0, 0).when(digits * 2 < F.length(m), 1).when(digits < F.length(m), 2).otherwise(3) + F.when(F.length(m) > 20, 4).otherwise(0)
    return F.struct(
        F.lit(KINDS.index(kind)).alias("kind"),
        x["start"].alias("start"),
        x["end"].alias("end"),
        base.alias("base"),
        _vote(m.rlike(_STRICT[kind]) & _valid(kind, m)).alias("v0"),
        _vote(m.rlike(_GAZETTEER[kind])).alias("v1"),
        _vote(before.rlike(_CUES[kind]), F.lit(False)).alias("v2"),
        _vote(~left.rlike("[A-Za-z0-9]") & ~right.rlike("[A-Za-z0-9]")).alias("v3"),
        shape.cast("int").alias("shape"),
    )


def candidates(df: DataFrame, text: str, name: str) -> DataFrame:
    """Adds the array of candidates of all kinds to every row."""
    body = F.coalesce(F.col(text), F.lit(""))
    parts = {free_name(df, f"_{kind}_{of_base}"): (kind, of_base) for kind, of_base in _NEEDS}
    placed = df.withColumns({c: _matches(*how, body) for c, how in parts.items()})
    placed = placed.withColumns({c: _placed(F.col(c)) for c in parts})
    lists = []
    for c, (kind, base) in parts.items():
        lists.append(F.transform(c, partial(_candidate, kind, base, body)))
    return placed.withColumn(name, F.concat(*lists)).drop(*parts)


@dataclass
class SpanModel:
    """Log-odds weights of the span classifier, and what expectation-maximisation estimated."""

    bias: float = -1.0
    kinds: list[float] = field(default_factory=lambda: [0.0] * len(KINDS))
    votes: list[list[float]] = field(default_factory=lambda: [[-1.0, 0.0, 1.0] for _ in range(LABELERS)])
    shapes: list[float] = field(default_factory=lambda: [0.0] * SHAPES)
    reliability: list[float] = field(default_factory=lambda: [0.5] * LABELERS)

    def log_odds(self, x: Column) -> Column:
        pick = lambda values, i: F.get(F.array(*map(F.lit, values)), i)
        total = F.lit(self.bias) + pick(self.kinds, x["kind"]) + pick(self.shapes, x["shape"])
        for k in range(LABELERS):
            total = total + pick(self.votes[k], x[f"v{k}"])
        return total


def _posteriors(rows: list[tuple[int, tuple[int, ...], float]], rounds: int) -> tuple[list[float], list[float]]:
    """Expectation-maximisation over vote patterns: P(true) for each row, and each labeler's accuracy."""
    p = [min(0.95, max(0.05, sum(v - 1 for v in votes) / (2 * LABELERS) + 0.5)) for _, votes, _ in rows]
    told = [[[1 / 3] * 3 for _ in range(2)] for _ in range(LABELERS)]
    for _ in range(rounds):
        prior = [[1.0, 1.0] for _ in KINDS]
        seen = [[[1.0] * 3 for _ in range(2)] for _ in range(LABELERS)]
        for k in range(LABELERS):  # a labeler is taken to be right more often than not
            seen[k][1][2] += 2
            seen[k][0][0] += 2
        for (kind, votes, n), q in zip(rows, p, strict=True):
            for y, share in ((0, 1 - q), (1, q)):
                prior[kind][y] += n * share
                for k, v in enumerate(votes):
                    seen[k][y][v] += n * share
        told = [[[c / sum(row) for c in row] for row in both] for both in seen]
        p = []
        for kind, votes, _ in rows:
            odds = math.log(prior[kind][1] / prior[kind][0])
            for k, v in enumerate(votes):
                odds += math.log(told[k][1][v] / told[k][0][v])
            p.append(1 / (1 + math.exp(-max(-30.0, min(30.0, odds)))))
    return p, [(told[k][1][2] + told[k][0][0]) / 2 for k in range(LABELERS)]


def fit(found: DataFrame, column: str, rounds: int = 20, steps: int = 60, rate: float = 1.0) -> SpanModel:
    """Learns from the candidates of all rows; only their counts by pattern reach the driver."""
    x = found.select(F.explode(column).alias("c"))
    keys = ["kind", *(f"v{k}" for k in range(LABELERS)), "shape"]
    counted = x.groupBy(*(F.col(f"c.{k}").alias(k) for k in keys)).count().orderBy(*keys).collect()
    model = SpanModel()
    if not counted:
        return model
    rows = [(r["kind"], tuple(r[f"v{k}"] for k in range(LABELERS)), float(r["count"])) for r in counted]
    p, model.reliability = _posteriors(rows, rounds)
    total = sum(n for *_, n in rows)
    for _ in range(steps):
        grad_bias, grad_kind, grad_shape = 0.0, [0.0] * len(KINDS), [0.0] * SHAPES
        grad_vote = [[0.0] * 3 for _ in range(LABELERS)]
        for r, (kind, votes, n), target in zip(counted, rows, p, strict=True):
            z = model.bias + model.kinds[kind] + model.shapes[r["shape"]] + sum(model.votes[k][v] for k, v in enumerate(votes))
            d = n * (target - 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))) / total
            grad_bias += d
            grad_kind[kind] += d
            grad_shape[r["shape"]] += d
            for k, v in enumerate(votes):
                grad_vote[k][v] += d
        model.bias += rate * grad_bias
        model.kinds = [w + rate * g for w, g in zip(model.kinds, grad_kind, strict=True)]
        model.shapes = [w + rate * g for w, g in zip(model.shapes, grad_shape, strict=True)]
        model.votes = [[w + rate * g for w, g in zip(ws, gs, strict=True)] for ws, gs in zip(model.votes, grad_vote, strict=True)]
    return model


def detect(df: DataFrame, model: SpanModel | None = None, text: str = "text", name: str = "spans", keep_text: bool = True) -> DataFrame:
    """Adds ``name``: the sorted array of (start, kind, end, base), kind as an index of ``KINDS``.

    Without a model, the candidates are written to the shared folder, the model learns from them,
    and the same candidates are judged: texts are searched once.
    """
    found, base = free_name(df, "_found"), free_name(df, "_base")
    a = candidates(df, text, found)
    a = a if keep_text else a.drop(text)
    if model is None:
        a = written(a, "pii")
        model = fit(a, found)
    a = a.withColumn(base, F.filter(found, lambda x: x["base"]))
    span = lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), x["base"].alias("base"))
    clear = lambda x: ~F.exists(base, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
    loose = [KINDS.index(k) for k in _LOOSE]
    added = F.filter(found, lambda x: ~x["base"] & x["kind"].isin(loose) & (model.log_odds(x) > 0) & clear(x))
    spans = F.sort_array(F.concat(F.transform(base, span), F.transform(added, span)))
    return a.withColumn(name, spans).drop(found, base)


def named(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])), ",")


def mask(df: DataFrame, model: SpanModel | None = None, text: str = "text") -> DataFrame:
    """Replaces every span by its kind in brackets; overlapping spans become one, of the first's kind."""
    spans = free_name(df, "_spans")
    a = detect(df, model, text, spans)
    kinds = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    body = F.coalesce(F.col(text), F.lit(""))

    def step(at, s):
        fresh = s["start"] >= at
        piece = F.concat(F.substr(body, at + 1, s["start"] - at), F.get(kinds, s["kind"]))
        return F.greatest(at, s["end"]), F.when(fresh, piece).otherwise(F.lit(""))

    parts = scan(F.col(spans), 0, step, "string")
    last = F.array_max(F.transform(spans, lambda s: s["end"]))
    out = F.when(F.size(spans) > 0, F.concat(F.array_join(parts, ""), F.substr(body, last + 1, F.length(body)))).otherwise(F.col(text))
    return a.withColumn(text, out).drop(spans)
