"""Personal data by weak supervision, in DataFrame functions only.

Every shape (an address, a dotted quad, a digit run, a written number, a name, a key) has a
pattern that proposes spans. Four labelers vote on each proposal: the strict format, a
gazetteer, the words before it, and its borders. Expectation-maximisation over the counts of
vote patterns estimates each labeler's reliability and each shape's share of personal data,
without labels. Its posteriors train the final span classifier, a logistic model over the
span's discrete features, which is then one column expression. Spans of the four base
formats always stay; others are added where the classifier is sure.

A text is scanned once per shape with the pattern's matches and the pieces between them, so
places are sums of lengths; patterns use possessive runs that start only where a run can
start, so scanning is linear. Only counts of vote patterns and of feature combinations
(``shapes x 3^4`` rows) reach the driver. No rows meet, so no key can be hot.

Cases: a null or empty text has no spans; equal documents get equal rows; overlapping spans
of different kinds are all reported, and masked as one; an empty table gives no rows; a small one trains on
counts over the same prior as a large one; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from evalspark.functions.binding import bind
from evalspark.session import cut_lineage

KINDS = ["email", "ip", "card", "phone", "ssn", "name", "secret"]
BASE_KINDS = KINDS[:4]
#: Posterior from which a span that is in no base format is added.
SURE = 0.9
EM_ROUNDS = 50
#: What a vote is worth before any is counted: votes of personal and of other spans.
PRIOR = {1: (4.0, 1.0), -1: (1.0, 4.0)}
FIT_ROUNDS = 300
#: Characters before a span that the context labeler reads.
CONTEXT = 24


@dataclass(frozen=True)
class Shape:
    """A span proposal: its kind, its pattern, and a text that must occur for the pattern to be tried."""

    name: str
    kind: str
    pattern: str
    base: bool
    needs: str


#: The gazetteer of given names.
GIVEN_NAMES = r"(?:James|Mary|Robert|Patricia|John|Jennifer|Michael|Linda|David|Elizabeth|William|Barbara|Richard|Susan|Joseph|Jessica|Thomas|Sarah|Charles|Karen|Anna|Maria|Peter|Paul|Hans|Jean|Pierre|Juan|Carlos|Sofia)"
_LOCAL = r"[A-Za-z0-9._%+-]"
SHAPES = [
    Shape("email", "email", rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", True, "@"),
    Shape("ip", "ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", True, "[0-9]\\.[0-9]"),
    Shape("card", "card", r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}(?![\x20-]?[0-9])", True, "[0-9][\\x20-]?[0-9]"),
    Shape("phone", "phone", r"\+[0-9][\x20().0-9-]+[0-9]", True, "\\+[0-9]"),
    Shape("local_phone", "phone", r"(?<!\+[0-9]{1,3}[\x20.-])(?<![0-9A-Za-z+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.\x20-])[0-9]{3}[.\x20-][0-9]{4}(?![0-9A-Za-z-])", False, "[0-9]{3}[.\\x20-][0-9]{4}"),
    Shape("ssn", "ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", False, "[0-9]-[0-9]{2}-[0-9]"),
    Shape("name", "name", r"(?<![\w.])(?:Mr|Mrs|Ms|Dr|Prof)\.?\x20[A-Z][a-z]++(?:\x20[A-Z][a-z]++)?(?!\w)", False, "(?:Mr|Mrs|Ms|Dr|Prof)\\.?\\x20[A-Z]"),
    Shape("given_name", "name", rf"(?<![\w.])(?<!(?:Mr|Mrs|Ms|Dr|Prof)\.?\x20){GIVEN_NAMES}(?:\x20[A-Z]\.)?\x20[A-Z][a-z]++(?!\w)", False, rf"{GIVEN_NAMES}\x20[A-Z]"),
    Shape("secret", "secret", r"(?<![A-Za-z0-9_/+-])(?=[A-Za-z_-]*+[0-9])(?=[0-9_-]*+[A-Za-z])[A-Za-z0-9_-]{24,}+(?![A-Za-z0-9_/+-])", False, "[A-Za-z0-9_-]{24}"),
]
SHAPE = {s.name: s for s in SHAPES}

# Words of the context and gazetteer labelers.
CONTEXT_FOR = r"(?i)(?:e-?mail|mail|phone|tel|telephone|mobile|fax|call|contact|reach|ssn|social security|card|visa|account|iban|ip|address|host|server|token|key|secret|password|passwd|pwd|name|dear|signed|from|by|to)\W{1,4}$"
CONTEXT_AGAINST = r"(?i)(?:version|ver|v|page|pages|fig|figure|table|section|chapter|isbn|issn|doi|order|total|sum|price|build|release|no|number|commit|sha|hash|md5|license|licence)\W{1,4}$"
NOT_A_NAME = r"\x20(?:The|Of|And|No|Street|Road|Avenue|University|Company|Inc)\b"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    doubled = F.transform(F.split(F.reverse(digits), "(?<=.)(?=.)"), lambda d, i: F.when(i % 2 == 0, d.cast("int"))
                          .otherwise(F.when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def _format(shape: Shape, value: Column) -> Column:
    """Whether the strict format holds."""
    if shape.name == "ip":
        return F.forall(F.split(value, "\\."), lambda p: p.cast("double") <= 255)
    if shape.name == "card":
        return luhn(_digits(value))
    if shape.name == "phone":
        return F.length(_digits(value)).between(10, 15)
    if shape.name == "ssn":
        return ~F.regexp_like(value, F.lit("^(?:000|666|9)|-00-|-0000$"))
    if shape.name == "local_phone":
        return ~F.regexp_like(value, F.lit(r"^\(?[01]"))
    if shape.name == "secret":
        return F.regexp_like(value, F.lit("^(?:[^0-9]*+[0-9]){3}"))
    return F.lit(True)


def _gazetteer(shape: Shape, value: Column) -> Column:
    if shape.name == "name":
        return F.when(F.regexp_like(value, F.lit(GIVEN_NAMES)), 1).when(F.regexp_like(value, F.lit(NOT_A_NAME)), -1).otherwise(0)
    if shape.name == "given_name":
        return F.when(F.regexp_like(value, F.lit(NOT_A_NAME)), -1).otherwise(1)
    if shape.name == "email":
        return F.when(F.regexp_like(value, F.lit(r"\.(?:com|org|net|edu|gov|io|de|fr|es|uk)$")), 1).otherwise(0)
    if shape.name == "ip":
        return F.when(F.regexp_like(value, F.lit(r"^(?:0|127)\.")), -1).otherwise(0)
    if shape.name == "card":
        return F.when(F.regexp_like(value, F.lit("^[3-6]")), 1).otherwise(-1)
    if shape.name == "secret":
        return F.when(F.regexp_like(value, F.lit("^(?:[0-9a-f]+|[0-9A-F]+)$")), 1).when(F.regexp_like(value, F.lit("[-_][a-z]+[-_]")), -1).otherwise(0)
    return F.lit(0)


#: Values folded into one appended array; appending copies, so longer arrays are folded block by block.
BLOCK = 256


def running(values: Column, fold: Callable[[Column, Column], Column]) -> Column:
    """``array<int>``: the fold of an array's values up to each place, for a fold to which 0 adds nothing."""
    none = F.array().cast("array<int>")

    def steps(part: Column, base: Column) -> Column:
        return F.aggregate(part, F.struct(base.alias("last"), none.alias("done")), lambda state, x: F.struct(
            fold(state["last"], x).alias("last"), F.array_append(state["done"], fold(state["last"], x)).alias("done")), lambda state: state["done"])

    def blocks(v: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int"))
        totals = F.transform(numbers, lambda n: F.aggregate(F.slice(v, n * BLOCK + 1, BLOCK), F.lit(0), fold))
        return bind(steps(totals, F.lit(0)), lambda t: F.flatten(F.transform(numbers, lambda n: steps(
            F.slice(v, n * BLOCK + 1, BLOCK), F.when(n == 0, F.lit(0)).otherwise(F.get(t, n - 1))))))
    return bind(values, lambda v: F.when(F.size(v) == 0, none).otherwise(blocks(v)))


def matches(text: Column, shape: Shape) -> Column:
    """``array<struct<at,until,value,before,after>>`` of a shape's matches, in code points."""
    def places(s: Column) -> Column:
        sizes = F.transform(s["values"], lambda v, i: F.length(F.get(s["pieces"], i)) + F.length(v))
        return bind(running(sizes, lambda end, n: end + n), lambda ends: F.transform(s["values"], lambda v, i: F.struct(
            (F.get(ends, i) - F.length(v)).alias("at"), F.get(ends, i).alias("until"), v.alias("value"),
            F.right(F.get(s["pieces"], i), F.lit(CONTEXT)).alias("before"), F.left(F.get(s["pieces"], i + 1), F.lit(1)).alias("after"))))
    both = F.struct(F.split(text, shape.pattern, -1).alias("pieces"), F.regexp_extract_all(text, F.lit(shape.pattern), 0).alias("values"))
    empty = F.array().cast("array<struct<at:int,until:int,value:string,before:string,after:string>>")
    return F.when(F.regexp_like(text, F.lit(shape.needs)), bind(both, places)).otherwise(empty)


def _voted(found: Column, shape: Shape) -> Column:
    """Matches as proposals with the four votes and the classifier's features."""
    def vote(x: Column) -> Column:
        strict = _format(shape, x["value"])
        context = F.when(F.regexp_like(x["before"], F.lit(CONTEXT_AGAINST)), -1).when(F.regexp_like(x["before"], F.lit(CONTEXT_FOR)), 1).otherwise(0)
        open_left, open_right = F.regexp_like(x["before"], F.lit(r"\w$")), F.regexp_like(x["after"], F.lit(r"\w"))
        return F.struct(
            x["at"].alias("at"), F.lit(KINDS.index(shape.kind)).alias("rank"), x["until"].alias("until"),
            F.lit(shape.name).alias("shape"), (strict & F.lit(shape.base)).alias("base"),
            F.when(strict, 1).otherwise(-1).alias("v_format"), _gazetteer(shape, x["value"]).cast("int").alias("v_gazetteer"),
            context.alias("v_context"), F.when(open_left | open_right, -1).otherwise(1).alias("v_border"),
            F.least(F.floor(F.length(x["value"]) / 8), F.lit(4)).cast("int").alias("size"))
    return F.transform(found, vote)


VOTES = ["v_format", "v_gazetteer", "v_context", "v_border"]
FEATURES = ["shape", *VOTES, "size"]


def proposals(documents: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (the id) and ``proposals``: every document's proposals of all shapes, with votes."""
    kept = [F.col(name).alias(f"_kept_{name}") for name in keep or ["doc_id"]]
    rows = documents.select(*kept, F.coalesce(F.col("text"), F.lit("")).alias("_text"))
    names = [f"_kept_{name}" for name in keep or ["doc_id"]]
    found = rows.select(*names, *[matches(F.col("_text"), s).alias(f"_{s.name}") for s in SHAPES])
    return found.select(*[F.col(n).alias(n.removeprefix("_kept_")) for n in names],
                        F.sort_array(F.concat(*[_voted(F.col(f"_{s.name}"), s) for s in SHAPES])).alias("proposals"))


# --- the label model and the classifier: arithmetic over bounded tables of counts ------------


@dataclass
class Model:
    """Weights of the logistic span classifier by ``(feature, value)``, and what the labelers are worth."""

    weights: dict[tuple[str, object], float]
    reliabilities: dict[tuple[str, int], tuple[float, float]]

    def margin(self, span: Column) -> Column:
        total = F.lit(self.weights.get(("", ""), -10.0))
        for feature in FEATURES:
            known = {v: w for (f, v), w in self.weights.items() if f == feature}
            value = F.lit(-1.0) if known else F.lit(0.0)
            for v, w in known.items():
                value = F.when(span[feature] == F.lit(v), F.lit(w)).otherwise(value)
            total = total + value
        return total


def label_model(counts: list[tuple[str, tuple[int, ...], int]]) -> tuple[dict, dict]:
    """Expectation-maximisation over ``(shape, votes, count)``: posteriors and vote likelihoods.

    The hidden class of a span draws each vote on its own; abstentions (0) say nothing. Votes are
    shared by all shapes, the class share is a shape's own. The first posteriors are those of the majority.
    """
    posterior = {(shape, votes): 1 / (1 + math.exp(-1.5 * sum(votes))) for shape, votes, _ in counts}
    likelihood: dict = {}
    for _ in range(EM_ROUNDS):
        mass: dict = {(k, v): PRIOR[v] for k in range(len(VOTES)) for v in PRIOR}
        share: dict = {}
        for shape, votes, n in counts:
            p = posterior[shape, votes]
            pos, total = share.get(shape, (1.0, 2.0))
            share[shape] = (pos + n * p, total + n)
            for k, v in ((k, v) for k, v in enumerate(votes) if v):
                a, b = mass[k, v]
                mass[k, v] = (a + n * p, b + n * (1 - p))
        likelihood = {}
        for k in range(len(VOTES)):
            values = [v for j, v in mass if j == k]
            sums = [sum(mass[k, v][side] for v in values) for side in (0, 1)]
            for v in values:
                likelihood[k, v] = (mass[k, v][0] / sums[0], mass[k, v][1] / sums[1])
        for shape, votes, _ in counts:
            odds = math.log(share[shape][0] / (share[shape][1] - share[shape][0]))
            odds += sum(math.log(likelihood[k, v][0] / likelihood[k, v][1]) for k, v in enumerate(votes) if v)
            posterior[shape, votes] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return posterior, likelihood


def fit_classifier(rows: list[tuple[dict, int, float]]) -> dict[tuple[str, object], float]:
    """Logistic regression on ``(features, count, soft label)`` by gradient steps over the table."""
    weights: dict[tuple[str, object], float] = {("", ""): 0.0}
    for features, _, _ in rows:
        weights.update({(f, v): 0.0 for f, v in features.items()})
    squares = dict.fromkeys(weights, 1e-6)
    total = sum(n for _, n, _ in rows)
    for _ in range(FIT_ROUNDS):
        gradient = {key: 1e-4 * w for key, w in weights.items()}
        for features, n, label in rows:
            keys = [("", ""), *features.items()]
            error = (1 / (1 + math.exp(-max(-30.0, min(30.0, sum(weights[k] for k in keys))))) - label) * n / total
            for key in keys:
                gradient[key] += error
        for key, g in gradient.items():
            squares[key] += g * g
            weights[key] -= 0.3 * g / math.sqrt(squares[key])
    return weights


def train(found: DataFrame) -> Model:
    """Fit label model and classifier on the counts of all proposals."""
    spans = found.select(F.explode("proposals").alias("p")).select("p.*")
    rows = spans.groupBy(*FEATURES).count().orderBy(*FEATURES).collect()  # shapes x 3^4 x 5 rows at most
    votes = [(r["shape"], tuple(r[v] for v in VOTES), r["count"]) for r in rows]
    merged: dict = {}
    for shape, v, n in votes:
        merged[shape, v] = merged.get((shape, v), 0) + n
    posterior, likelihood = label_model([(s, v, n) for (s, v), n in merged.items()])
    table = [({f: r[f] for f in FEATURES}, r["count"], posterior[shape, v]) for r, (shape, v, _) in zip(rows, votes)]
    return Model(fit_classifier(table), {(VOTES[k], v): pair for (k, v), pair in likelihood.items()})


def _kept_spans(model: Model) -> Column:
    """The proposals in base formats and those the classifier is sure of, as sorted spans."""
    sure = math.log(SURE / (1 - SURE))

    def kept(p: Column) -> Column:
        return p["base"] | (~p["shape"].isin([s.name for s in SHAPES if s.base]) & (p["v_format"] == 1) & (model.margin(p) >= sure))
    kinds = F.array(*[F.lit(k) for k in KINDS])
    spans = F.transform(F.filter("proposals", kept), lambda p: F.struct(
        p["at"].alias("at"), p["rank"].alias("rank"), p["until"].alias("until"), F.get(kinds, p["rank"]).alias("kind"), p["base"].alias("base")))
    # sorted again by their own fields, equal spans are neighbours
    return bind(F.sort_array(spans), lambda a: F.filter(a, lambda x, i: (i == 0) | (x != F.get(a, i - 1))))


def find_personal_data(documents: DataFrame) -> DataFrame:
    """``(doc_id, spans)``: sorted structs ``(at, rank, until, kind, base)`` of every document."""
    found = cut_lineage(proposals(documents))
    return found.select("doc_id", _kept_spans(train(found)).alias("spans"))


def mask_personal_data(documents: DataFrame) -> DataFrame:
    """The documents with every span replaced by its kind in brackets; ``n_chars`` follows where there is one."""
    names = documents.columns
    # the caller's columns travel under names of ours, so that none can clash
    apart = documents.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(names)], "text")
    found = cut_lineage(proposals(apart, [f"_c{i}" for i in range(len(names))]))
    text = F.col(f"_c{names.index('text')}")
    rows = found.select(*[f"_c{i}" for i in range(len(names))], _kept_spans(train(found)).alias("_spans"))
    rows = rows.withColumn("_text", F.when(text.isNotNull(), masked(text, F.col("_spans"))))
    changed = {"text": F.col("_text")} | ({"n_chars": F.length("_text").cast(documents.schema["n_chars"].dataType)} if "n_chars" in names else {})
    return rows.select(*[changed.get(c, F.col(f"_c{i}")).alias(c) for i, c in enumerate(names)])


def span_texts(spans: Column) -> Column:
    """``kind:start:end`` of every span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["at"].cast("string"), s["until"].cast("string"))), ",")


def masked(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets; overlapping spans go as one, under the longest one's kind."""
    def together(p: Column, reach: Column) -> Column:
        """Unions of overlapping spans: a union begins where a span begins behind the reach of all before it."""
        n = F.size(p)
        first = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(p, i)["at"] >= F.get(reach, i - 1)))

        def union(f: Column, a: Column, g: Column) -> Column:
            end = F.coalesce(F.get(f, g + 1), n)
            longest = F.aggregate(F.slice(p, a + 1, end - a), F.struct(F.lit("").alias("kind"), F.lit(0).alias("size")), lambda best, x: F.when(
                x["until"] - x["at"] > best["size"], F.struct(x["kind"].alias("kind"), (x["until"] - x["at"]).alias("size"))).otherwise(best))
            return F.struct(F.get(p, a)["at"].alias("at"), F.get(reach, end - 1).alias("until"), longest["kind"].alias("kind"))
        return bind(first, lambda f: F.transform(f, lambda a, g: union(f, a, g)))

    reach = running(F.transform(spans, lambda x: x["until"]), lambda a, x: F.greatest(a, x))
    unions = bind(F.struct(spans.alias("p"), reach.alias("r")), lambda b: together(b["p"], b["r"]))
    def block(t: Column, u: Column, k: Column) -> Column:
        """The text from the union before the block's first to its last; cut out once, as a cut walks from the text's start."""
        base = F.when(k == 0, F.lit(0)).otherwise(F.get(u, k * BLOCK - 1)["until"])
        last = F.get(u, F.least((k + 1) * BLOCK, F.size(u)) - 1)["until"]

        def piece(c: Column, x: Column, i: Column) -> Column:
            before = F.when(i == 0, c["base"]).otherwise(F.get(c["part"], i - 1)["until"])
            return F.concat(F.substring(c["cut"], before - c["base"] + 1, x["at"] - before), F.lit("["), F.upper(x["kind"]), F.lit("]"))
        cut = F.struct(F.substring(t, base + 1, last - base).alias("cut"), F.slice(u, k * BLOCK + 1, BLOCK).alias("part"), base.alias("base"))
        return bind(cut, lambda c: F.array_join(F.transform(c["part"], lambda x, i: piece(c, x, i)), ""))

    def replaced(t: Column, u: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(u) - 1) / BLOCK).cast("int"))
        rest = F.substring(t, F.get(u, F.size(u) - 1)["until"] + 1, F.length(t))
        return F.concat(F.array_join(F.transform(numbers, lambda k: block(t, u, k)), ""), rest)
    pieces = bind(F.struct(text.alias("t"), unions.alias("u")), lambda b: replaced(b["t"], b["u"]))
    return F.when(F.size(spans) == 0, text).otherwise(pieces)
