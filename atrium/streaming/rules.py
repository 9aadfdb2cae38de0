"""Event rules: conditions on payload fields, and the actions of the rules that match.  Works on batches and streams alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The operators of conditions and the events that rules can name.
OPERATORS = ("equals", "notEquals", "in", "notIn", "gt", "lt")


NUMBERS = r"^(TINYINT|SMALLINT|INT|BIGINT|DECIMAL.*|FLOAT|DOUBLE)$"


def _number(value: Column) -> Column:
    """The value of a variant that is a number, else null."""
    return F.when(F.schema_of_variant(value).rlike(NUMBERS), F.try_variant_get(value, "$", "double"))


def _key(value: Column) -> Column:
    """Text that is equal for strictly equal scalars: of one kind and value.  Lists and objects equal nothing, so they have none."""
    kind = F.schema_of_variant(value)
    return F.when(kind.rlike(NUMBERS), F.concat(F.lit("number "), _number(value).cast("string"))).when(~kind.rlike("^(ARRAY|OBJECT)"), F.to_json(value))


def holds(operator: Column, field: Column, value: Column) -> Column:
    """Whether a payload field (variant, null if it is missing) meets a condition's value (JSON text).

    Types must agree: the string "60" neither equals 60 nor is it over 50.  ``in`` and ``notIn`` ask for a list and
    ``gt`` and ``lt`` for two numbers, else they do not hold; nor does an unknown operator.
    """
    wanted = F.try_parse_json(value)
    same = F.coalesce(_key(field) == _key(wanted), field.isNull() & value.isNull())
    items = F.try_variant_get(wanted, "$", "array<variant>")
    listed = F.exists(items, lambda item: F.coalesce(_key(item) == _key(field), F.lit(False)))
    return F.coalesce(
        F.when(operator == "equals", same).when(operator == "notEquals", ~same).when(operator == "in", listed).when(operator == "notIn", ~listed)
        .when(operator == "gt", _number(field) > _number(wanted)).when(operator == "lt", _number(field) < _number(wanted)),
        F.lit(False),
    )


def matched(events: DataFrame, rules: DataFrame, most_broadcast: int = 10_000) -> DataFrame:
    """Events (event_id, event, payload: JSON) joined with rules (rule_id, event, conditions: array of field, operator, value; actions: array) that match.

    All conditions must hold; none at all holds.  A field may be a path (``a.b``).  Up to ``most_broadcast`` rules are broadcast, so
    that events of one hot kind stay where they are; more rules are joined by event.  One row per action: event_id, rule_id, ord, action.
    """
    few = not rules.isStreaming and rules.limit(most_broadcast + 1).count() <= most_broadcast
    pair = events.withColumn("_payload", F.try_parse_json("payload")).join(F.broadcast(rules) if few else rules, "event")
    good = F.forall("conditions", lambda c: holds(c.operator, F.try_variant_get("_payload", F.concat(F.lit("$."), c.field), "variant"), c.value))
    return pair.filter(F.coalesce(good, F.col("conditions").isNull())).select("event_id", "rule_id", F.posexplode("actions").alias("ord", "action"))


def lint(rules: DataFrame, events: tuple[str, ...], actions: tuple[str, ...]) -> DataFrame:
    """rule_id, problem: unknown events, operators and actions."""
    bad = [
        F.when(~F.col("event").isin(*events), F.concat(F.lit("unknown event "), "event")),
        F.when(F.exists("conditions", lambda c: ~c.operator.isin(*OPERATORS)), F.lit("unknown operator")),
        F.when(F.exists("actions", lambda a: ~a.isin(*actions)), F.lit("unknown action")),
    ]
    return rules.select("rule_id", F.explode(F.array_compact(F.array(*bad))).alias("problem"))
