"""Model replies: JSON recovery by family, and validation of scores and stage objects.

Replies stay in ``VARIANT`` so that a value's JSON type is known before it is cast: a
text ``"4"`` or a ``true`` must not turn into a score by coercion.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from evalspark.functions.binding import bind
from evalspark.functions.text import WS, is_blank, strip

# Reply patterns. The object pattern is possessive so long texts cannot
# exhaust the regex stack; it matches the same strings as the greedy form.
THINK_BLOCK = r"(?s)<think>(.*?)</think>"
JSON_FENCE = rf"(?md)^```json[{WS}]*|[{WS}]*```$"
FLAT_OBJECT = r"\{[^{}]*+(?:\{[^{}]*+\}[^{}]*+)*+\}"
FENCED_OBJECT = rf"(?s)```(?:json)?[{WS}]*(\{{.*?\}})[{WS}]*```"
DIMENSION_DECLARED = rf'"(dimension_\d+_[a-z_]+)"[{WS}]*:'
DIMENSION_KEY = r"^dimension_\d+_.+"
INTEGER_TEXT = r"^[+-]?\d+(_\d+)*$"


def _get(value: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(value, path, kind)


def _type(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value), F.lit("VOID"))


def _is_object(value: Column) -> Column:
    return _type(value).startswith("OBJECT")


def _is_list(value: Column) -> Column:
    return _type(value).startswith("ARRAY")


def _is_text(value: Column) -> Column:
    return (_type(value) == "STRING") & ~is_blank(_get(value, "$", "string"))


def _items(value: Column) -> Column:
    return _get(value, "$", "array<variant>")


def parse_object(text: Column) -> Column:
    """The text as a JSON object, NULL unless the *whole* text is one object."""
    return bind(parse_value(text), lambda value: F.when(_is_object(value), value))


def parse_value(text: Column) -> Column:
    """The text as one JSON value of any type, NULL unless the whole text is one value.

    The engine's parser ignores trailing characters, so the text is parsed inside two
    wrappers with an end mark each; text that breaks out of one cannot satisfy both.
    """
    def read(raw: Column) -> Column:
        keyed = F.try_parse_json(F.concat(F.lit('{"v":'), raw, F.lit(',"__eof__":0}')))
        closed = _get(keyed, "$.__eof__", "int") == 0

        def first(listed: Column) -> Column:
            whole = (_get(listed, "$[1]", "int") == 0) & _get(listed, "$[2]").isNull() & closed
            return F.when(whole, _get(listed, "$[0]"))

        return bind(F.try_parse_json(F.concat(F.lit("["), raw, F.lit(",0]"))), first)

    return bind(text, read)


def split_reasoning(text: Column) -> Column:
    """``struct(answer, trace)``: the reply without think blocks, and the blocks' texts."""
    blocks = F.regexp_extract_all(text, F.lit(THINK_BLOCK), F.lit(1))
    return F.struct(
        strip(F.regexp_replace(text, THINK_BLOCK, "")).alias("answer"),
        F.array_join(F.transform(blocks, strip), "\n").alias("trace"),
    )


def recover_strict(text: Column) -> Column:
    """Strip a code fence, parse once, no rescue of prose around the object."""
    return parse_object(F.regexp_replace(strip(text), JSON_FENCE, ""))


def recover_ladder(text: Column) -> Column:
    """Whole text, else the first flat object in it, else a fenced object."""
    return bind(strip(text), lambda content: F.coalesce(
        parse_object(content),
        parse_object(F.regexp_extract(content, FLAT_OBJECT, 0)),
        parse_object(F.regexp_extract(content, FENCED_OBJECT, 1))))


def recover_outermost(text: Column) -> Column:
    """Strip fences, else everything from the first ``{`` to the last ``}``."""
    body = F.regexp_replace(strip(text), r"^```(?:json)?", "")
    body = F.when(body.endswith("```"), strip(F.regexp_replace(body, r"```$", ""))).otherwise(body)
    # a text that is JSON as a whole is taken as it is, so a list around an object is refused
    def outermost(b: Column) -> Column:
        return bind(parse_value(b), lambda value: F.when(_is_object(value), value).when(
            value.isNull(), parse_object(F.regexp_extract(b, r"(?s)\{.*\}", 0))))
    return bind(body, outermost)


def declared_dimensions(template: Column) -> Column:
    """Dimension keys a rubric asks for, in its order."""
    return F.regexp_extract_all(template, F.lit(DIMENSION_DECLARED), F.lit(1))


def score_dimensions(parsed: Column, expected: Column, low: int = 0, high: int = 5) -> Column:
    """``struct(scores map<string,int>, problems array<string>)``; nothing is coerced."""
    scored = bind(_get(parsed, "$", "map<string,variant>"), lambda members: _score_members(members, expected, low, high))
    return F.when(parsed.isNotNull(), scored).otherwise(
        F.struct(F.lit(None).cast("map<string,int>").alias("scores"),
                 F.array(F.lit("no JSON object")).alias("problems")))


def _score_members(members: Column, expected: Column, low: int, high: int) -> Column:
    found = F.filter(F.map_keys(members), lambda k: k.rlike(DIMENSION_KEY))

    def judge(key: Column) -> Column:
        info = F.element_at(members, key)
        score = _get(info, "$.score")
        value = _get(info, "$.score", "bigint")
        problem = (
            F.when(~_is_object(info), F.concat(key, F.lit(": not an object")))
            .when(_type(score) != "BIGINT", F.concat(key, F.lit(": score is not an integer")))
            .when(~value.between(low, high), F.concat(key, F.lit(": score out of range")))
        )
        return F.struct(key.alias("key"), value.cast("int").alias("value"), problem.alias("problem"))

    def collect(judged: Column) -> Column:
        listed = F.concat(
            F.transform(F.array_except(expected, found), lambda k: F.concat(F.lit("missing: "), k)),
            F.transform(F.array_sort(F.array_except(found, expected)), lambda k: F.concat(F.lit("unexpected: "), k)),
            F.transform(F.filter(judged, lambda j: j["problem"].isNotNull()), lambda j: j["problem"]))
        good = F.filter(judged, lambda j: j["problem"].isNull())
        scores = F.map_from_arrays(F.transform(good, lambda j: j["key"]), F.transform(good, lambda j: j["value"]))
        return F.struct(scores.alias("scores"), listed.alias("problems"))

    return bind(F.transform(expected, judge), collect)


def score_single(parsed: Column, low: Column, high: Column) -> Column:
    """``struct(score, key, problems)`` from ``score``, else ``rating``, with a reasoning text."""
    return bind(parsed, lambda p: _single_score(p, low, high))


def _single_score(parsed: Column, low: Column, high: Column) -> Column:
    scored = _type(_get(parsed, "$.score")) != "VOID"
    key = F.when(scored, "score").otherwise("rating")
    reasoning = F.when(~_is_text(_get(parsed, "$.reasoning")), "missing reasoning")

    def judge(value: Column, kind: Column) -> Column:
        problem = (
            F.when(kind == "VOID", "no score")
            .when(kind == "BOOLEAN", "boolean score")
            .when(value.isNull(), "score is not an integer")
            .when(~value.between(low, high), "score out of range"))
        problems = F.when(parsed.isNull(), F.array(F.lit("no JSON object"))).otherwise(
            F.array_compact(F.array(reasoning, problem)))
        score = F.when(parsed.isNotNull() & problem.isNull(), value.cast("int"))
        return F.struct(score.alias("score"), F.when(parsed.isNotNull(), key).otherwise("").alias("key"),
                        problems.alias("problems"))

    raw = F.when(scored, _get(parsed, "$.score")).otherwise(_get(parsed, "$.rating"))
    typed = bind(raw, lambda r: F.struct(_integer(r).alias("value"), _type(r).alias("kind")))
    return bind(typed, lambda t: judge(t["value"], t["kind"]))


def _integer(value: Column) -> Column:
    """A number or integer text as BIGINT (fractions truncate); NULL for anything else."""
    kind, text = _type(value), strip(_get(value, "$", "string"))
    return (
        F.when(kind == "BIGINT", _get(value, "$", "bigint"))
        .when(kind.startswith("DECIMAL") | (kind == "DOUBLE"), _get(value, "$", "double").cast("bigint"))
        .when((kind == "STRING") & text.rlike(INTEGER_TEXT), F.regexp_replace(text, "_", "").try_cast("bigint")))


def score_range(metric: Column) -> tuple[Column, Column]:
    """The rubric's own scale: 1-3 for ratings, 1-5 for failure scores."""
    return F.lit(1), F.when(metric == "rating3", F.lit(3)).otherwise(F.lit(5))


def interpret(reply: Column, template: Column, by_dimension: Column, metric: Column) -> Column:
    """A judge's reply by its family: recovered, scored and explained in one struct.

    Where ``by_dimension`` holds, the dimensions that ``template`` declares are read from a
    strictly parsed object; elsewhere one score on the scale of ``metric``, after thoughts
    are split off. A reply that cannot be parsed is kept whole in ``raw_judge``; only rows
    without ``problems`` are judged.
    """
    low, high = score_range(metric)
    parts = split_reasoning(reply)
    single = bind(recover_ladder(parts["answer"]), lambda parsed: bind(score_single(parsed, low, high), lambda s: _judged(
        reply, parsed, s["problems"], score=s["score"], score_key=s["key"], scale_low=low, scale_high=high, judge_reasoning=parts["trace"])))
    dimensions = bind(recover_strict(reply), lambda parsed: bind(score_dimensions(parsed, declared_dimensions(template)), lambda s: _judged(
        reply, parsed, s["problems"], dimension_scores=s["scores"])))
    return F.when(by_dimension, dimensions).otherwise(single)


# Columns of an interpreted reply that depend on its family.
JUDGED = {"score": "int", "score_key": "string", "scale_low": "int", "scale_high": "int", "judge_reasoning": "string",
          "dimension_scores": "map<string,int>"}


def _judged(reply: Column, parsed: Column, problems: Column, **known: Column) -> Column:
    def finish(scores: Column) -> Column:
        values = F.map_values(scores)
        count = F.when(scores.isNull(), F.lit(0)).otherwise(F.size(values))
        total = F.aggregate(values, F.lit(0).cast("bigint"), lambda s, x: s + x)
        mean = F.when(count > 0, total.cast("double") / count)
        return F.struct(*[known.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in JUDGED.items()],
                        count.alias("dimension_count"), mean.alias("dimension_mean"),
                        F.when(parsed.isNull(), reply).alias("raw_judge"), problems.alias("problems"))
    return finish(known.get("dimension_scores", F.lit(None).cast("map<string,int>")))


def binary_value(value: Column) -> Column:
    """``true``/``false``/1/0 as BOOLEAN, NULL for any other JSON value (1.0 and "1" too)."""
    kind = _type(value)
    number = _get(value, "$", "bigint")
    return (F.when(kind == "BOOLEAN", _get(value, "$", "boolean"))
            .when((kind == "BIGINT") & number.isin(0, 1), number == 1))


def stage1_problem(parsed: Column, memory_ids: Column) -> Column:
    """First broken rule of a stage-1 reply, NULL when the cards are valid."""
    return bind(parsed, lambda p: bind(_get(p, "$.memory_boundary_cards"), lambda cards: _stage1(p, cards, memory_ids)))


def _stage1(parsed: Column, cards: Column, memory_ids: Column) -> Column:
    items = _items(cards)

    def non_empty_list(card: Column, name: str) -> Column:
        value = _get(card, f"$.{name}")
        return _is_list(value) & (F.size(_items(value)) > 0)

    def texts(value: Column) -> Column:
        return _is_list(value) & F.forall(_items(value), _is_text)

    def card_problem(card: Column) -> Column:
        factors = _get(card, "$.key_factors")
        rules = _get(card, "$.conditional_use_rules")
        has_factors = _type(factors) != "VOID"
        return (
            F.when(~_is_object(card), "card is not an object")
            .when(has_factors & ~texts(factors), "key_factors")
            .when(~has_factors & ~non_empty_list(card, "task_types"), "task_types")
            .when(~has_factors & ~non_empty_list(card, "counterfactual_settings"), "counterfactual_settings")
            .when(~has_factors & ~non_empty_list(card, "setting_use_assessments"), "setting_use_assessments")
            .when(~(texts(rules) & (F.size(_items(rules)) > 0)), "conditional_use_rules")
            .when(~_is_text(_get(card, "$.boundary_summary")), "boundary_summary")
        )

    ids = F.transform(F.filter(items, _is_object),
                      lambda c: F.when(_type(_get(c, "$.memory_id")) == "STRING", _get(c, "$.memory_id", "string")))
    problems = F.array_compact(F.transform(items, card_problem))
    return (
        F.when(parsed.isNull(), "no JSON object")
        .when(~_is_list(cards), "no card list")
        .when(~ids.eqNullSafe(memory_ids), "memory ids differ")
        .when(F.size(problems) > 0, F.element_at(problems, 1))
    )


def stage2_instructions(parsed: Column, memory_ids: Column) -> Column:
    """``struct(problem, instructions)`` with instructions in memory order.

    Ids missing from *every* entry are re-attached by position; any other difference
    from the exact id set is refused.
    """
    listed = _get(parsed, "$.memory_use_instructions")
    items = _items(listed)

    def id_text(item: Column) -> Column:
        return F.when(_type(_get(item, "$.memory_id")) == "STRING", _get(item, "$.memory_id", "string"))

    anonymous = (F.size(items) == F.size(memory_ids)) & F.forall(
        items, lambda i: _is_object(i) & F.coalesce(
            _get(i, "$.memory_id", "string").isin("", "0", "false"), F.lit(True)))
    named = F.when(
        anonymous, F.transform(items, lambda i, n: F.struct(F.get(memory_ids, n).alias("id"), i.alias("item")))
    ).otherwise(F.transform(F.filter(items, _is_object), lambda i: F.struct(id_text(i).alias("id"), i.alias("item"))))
    return bind(named, lambda bound: _check_instructions(parsed, listed, bound, memory_ids))


def _check_instructions(parsed: Column, listed: Column, named: Column, memory_ids: Column) -> Column:
    ids = F.transform(named, lambda x: x["id"])
    exact = (F.size(ids) == F.size(memory_ids)) & (F.size(F.array_except(memory_ids, ids)) == 0) & (
        F.size(F.array_except(ids, memory_ids)) == 0)

    exact = F.coalesce(exact, F.lit(False))

    def pick(table: Column, memory_id: Column) -> Column:
        item = F.element_at(table, memory_id)
        return F.struct(
            memory_id.alias("memory_id"),
            F.when(_is_text(_get(item, "$.use_instruction")), _get(item, "$.use_instruction", "string")).alias("use_instruction"),
            F.when(_is_text(_get(item, "$.rationale")), _get(item, "$.rationale", "string")).alias("rationale"),
        )

    # an exact set has unique non-null ids, so the lookup map is well defined
    by_id = F.map_from_entries(F.when(exact, named))
    ordered = bind(by_id, lambda table: F.transform(memory_ids, lambda m: pick(table, m)))
    return bind(ordered, lambda bound: _instruction_result(parsed, listed, exact, bound))


def _instruction_result(parsed: Column, listed: Column, exact: Column, ordered: Column) -> Column:
    problem = (
        F.when(parsed.isNull(), "no JSON object")
        .when(~_is_list(listed), "no instruction list")
        .when(~exact, "memory ids differ")
        .when(F.exists(ordered, lambda o: o["use_instruction"].isNull()), "use_instruction")
        .when(F.exists(ordered, lambda o: o["rationale"].isNull()), "rationale")
    )
    return F.struct(problem.alias("problem"), F.when(problem.isNull(), ordered).alias("instructions"))


def selected_ids(text: Column, memory_ids: Column, partition: bool) -> Column:
    """``struct(ids, problem)`` of a selector reply.

    Keep-list: a subset, returned in memory order. Partition: every id exactly once, in
    the order the groups name them. An absent list is empty; a list that is present but no
    list, and a group that is no object, are problems.
    """
    return bind(parse_object(strip(text)), lambda parsed: _selected(parsed, memory_ids, partition))


def _selected(parsed: Column, memory_ids: Column, partition: bool) -> Column:
    def as_texts(value: Column) -> Column:
        return F.transform(F.coalesce(_items(value), F.array().cast("array<variant>")), lambda v: _get(v, "$", "string"))

    present = _get(parsed, "$", "map<string,variant>")
    key = "groups" if partition else "keep_memory_ids"
    listed = _get(parsed, f"$.{key}")
    malformed = F.array_contains(F.map_keys(present), F.lit(key)) & ~_is_list(listed)
    if partition:
        groups = F.coalesce(_items(_get(parsed, "$.groups")), F.array().cast("array<variant>"))
        named = F.flatten(F.transform(groups, lambda g: as_texts(_get(g, "$.memory_ids"))))

        def odd(group: Column) -> Column:
            ids = F.array_contains(F.map_keys(_get(group, "$", "map<string,variant>")), F.lit("memory_ids"))
            return ~_is_object(group) | (ids & ~_is_list(_get(group, "$.memory_ids")))
        malformed = malformed | F.exists(groups, odd)
    else:
        named = as_texts(_get(parsed, "$.keep_memory_ids"))

    def decide(proposed: Column) -> Column:
        unknown = F.size(F.array_except(proposed, memory_ids)) > 0
        if partition:
            problem = (
                F.when(parsed.isNull(), "no JSON object").when(malformed, "groups are malformed")
                .when(F.size(F.array_distinct(proposed)) != F.size(proposed), "duplicate memory ids")
                .when(unknown | (F.size(F.array_except(memory_ids, proposed)) > 0), "ids do not cover the memories"))
            chosen = proposed
        else:
            problem = (F.when(parsed.isNull(), "no JSON object").when(malformed, "keep_memory_ids is not a list")
                       .when(unknown, "unknown memory id"))
            chosen = F.array_intersect(memory_ids, proposed)
        return F.struct(F.when(problem.isNull(), chosen).alias("ids"), problem.alias("problem"))

    return bind(named, decide)


def token_usage(payload: Column) -> Column:
    """Token counts of a reply's JSON across the known shapes; unknown stays NULL."""
    def number(*paths: str) -> Column:
        # the first *present* value decides, even when it is not a number
        expr = F.lit(None).cast("bigint")
        for path in reversed(paths):
            expr = F.when(_type(_get(payload, path)) != "VOID", _integer(_get(payload, path))).otherwise(expr)
        return expr

    def details(kind_a: str, kind_b: str, *names: str) -> Column:
        a = number(*[f"$.usage.{kind_a}.{n}" for n in names])
        b = number(*[f"$.usage.{kind_b}.{n}" for n in names])
        return F.when(_is_object(_get(payload, f"$.usage.{kind_a}"))
                      & (F.size(_get(payload, f"$.usage.{kind_a}", "map<string,variant>")) > 0), a).otherwise(b)

    given = number("$.usage.prompt_tokens", "$.usage.input_tokens")
    produced = number("$.usage.completion_tokens", "$.usage.output_tokens")
    total = F.coalesce(number("$.usage.total_tokens"), given + produced)
    return F.struct(
        given.alias("input_tokens"), produced.alias("output_tokens"), total.alias("total_tokens"),
        details("prompt_tokens_details", "input_tokens_details", "cached_tokens", "cache_read_input_tokens").alias("cached_input_tokens"),
        details("completion_tokens_details", "output_tokens_details", "reasoning_tokens", "thinking_tokens").alias("reasoning_tokens"),
        (given.isNotNull() | produced.isNotNull() | total.isNotNull()).alias("usage_available"),
    )


# Message fragments of errors worth retrying.
TRANSIENT_MARKERS = [
    "connection error", "connection reset", "connection refused", "connection aborted",
    "remote protocol error", "remoteprotocolerror", "read timeout", "readtimeout",
    "connect timeout", "connecttimeout", "timed out", "timeout", "rate limit", "rate_limit",
    "too many requests", "temporarily unavailable", "service unavailable", "bad gateway",
    "gateway timeout", "internal server error", "server disconnected", "http 429",
    "status code 429", "status_code=429", "http 500", "http 502", "http 503", "http 504",
]


def is_transient(status: Column, message: Column) -> Column:
    """Status 429 or 5xx, or a known fragment in the message."""
    by_status = F.coalesce((status == 429) | status.between(500, 599), F.lit(False))
    return by_status | F.coalesce(F.lower(message).rlike("|".join(TRANSIENT_MARKERS)), F.lit(False))
