"""Counters: event rules, change log, listing and public texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from footfall.functions.json import as_text_map, json_text
from footfall.ranges import clean_project_id

KEY = ["project_id", "counter_key"]
TEXT_FIELDS = ["display_name", "unit", "event_trigger", "is_public", "description"]

#: A rule table above either bound is joined by shuffle instead.
BROADCAST_ROWS = 100_000
BROADCAST_CHARS = 32_000_000
#: Names of properties that rules use, up to which they are written into the plan.
BROADCAST_NAMES = 1_000


def rules(counters: DataFrame) -> DataFrame:
    """Counters with a usable trigger, its event type and conditions taken apart.

    ``conditional`` is true if the trigger names conditions at all, JSON null
    included.  A condition that is an object or a list stands for the empty text.
    """
    trigger = F.col("event_trigger")
    conditions = json_text(trigger, "conditions")
    # The text of a nested value cannot be told from a string of that text, its type can.
    kinds = F.transform_values(F.from_json(conditions, "map<string,variant>"), lambda _, v: F.schema_of_variant(v))
    wanted = F.transform_values(
        as_text_map(conditions),
        lambda key, v: F.when(F.element_at(kinds, key).rlike("^(OBJECT|ARRAY)"), F.lit("")).otherwise(F.coalesce(v, F.lit("null"))),
    )
    return (
        counters.where(trigger.isNotNull())
        .select(
            *KEY, json_text(trigger, "event_type").alias("event_type"),
            F.coalesce(F.map_contains_key(as_text_map(trigger), F.lit("conditions")), F.lit(False)).alias("conditional"),
            F.coalesce(wanted, F.create_map().cast("map<string,string>")).alias("conditions"),
        )
        .where(F.col("event_type").isNotNull())
    )


def _sized(small: DataFrame, counters: DataFrame) -> DataFrame:
    """Broadcast hint for the rules if their measured size allows it."""
    size = counters.where(F.col("event_trigger").isNotNull()).agg(
        F.count(F.lit(1)), F.coalesce(F.sum(F.length("event_trigger")), F.lit(0))
    ).head()
    return F.broadcast(small) if size[0] <= BROADCAST_ROWS and size[1] <= BROADCAST_CHARS else small


def _all_equal(conditions: Column, given: Column) -> Column:
    """Every condition equals the text of its property."""
    return F.forall(F.map_entries(conditions), lambda c: F.coalesce(F.element_at(given, c["key"]) == c["value"], F.lit(False)))


def increments(events: DataFrame, counters: DataFrame) -> DataFrame:
    """How often the accepted events hit each counter of their project.

    The properties of an event are parsed once and cut down to the names that rules use, so wide
    properties are not multiplied.  A rule with conditions is met by an equi-join on the one that
    fewest events fulfil, so an event is not paired with every rule of its type.
    """
    known = _sized(rules(counters), counters)
    plain = known.where(F.size("conditions") == 0).select(*KEY, "event_type", "conditional")
    names = [r[0] for r in known.select(F.explode(F.map_keys("conditions"))).distinct().limit(BROADCAST_NAMES + 1).collect()]
    given = as_text_map(F.col("properties"))
    if len(names) <= BROADCAST_NAMES:
        given = F.map_filter(given, lambda name, _: name.isin(names))
    rows = events.select("project_id", "event_type", given.alias("given"), F.col("properties").isNotNull().alias("has_properties"))
    by_type = rows.join(plain, ["project_id", "event_type"]).where(~F.col("conditional") | F.col("has_properties")).select(*KEY)
    if not names:
        return by_type.groupBy(*KEY).agg(F.count(F.lit(1)).alias("hits"))
    members = rows.where("has_properties").select("project_id", "event_type", "given", F.explode("given").alias("name", "value"))
    picky = _met_at(known.where(F.size("conditions") > 0), members)
    by_value = members.join(picky, ["project_id", "event_type", "name", "value"]).where(_all_equal(F.col("conditions"), F.col("given"))).select(*KEY)
    return by_type.unionByName(by_value).groupBy(*KEY).agg(F.count(F.lit(1)).alias("hits"))


def _met_at(picky: DataFrame, members: DataFrame) -> DataFrame:
    """Rules with the condition they are met at: the only one, or the one that fewest events fulfil."""
    each = picky.select(*KEY, "event_type", "conditions", F.explode(F.map_entries("conditions")).alias("c"))
    each = each.select(*KEY, "event_type", "conditions", F.col("c.key").alias("name"), F.col("c.value").alias("value"))
    several = each.where(F.size("conditions") > 1)
    if several.isEmpty():
        return each
    pair = ["project_id", "event_type", "name", "value"]
    counts = members.join(several.select(*pair).distinct(), pair, "left_semi").groupBy(*pair).agg(F.count(F.lit(1)).alias("events"))
    weighed = several.join(counts, pair, "left")
    best = weighed.groupBy(*KEY, "event_type").agg(F.min_by(F.struct("conditions", "name", "value"), F.struct(F.coalesce("events", F.lit(0)), "name")).alias("b"))
    chosen = best.select(*KEY, "event_type", "b.*")
    return each.where(F.size("conditions") == 1).unionByName(chosen.select(*each.columns))


def as_changes(hits: DataFrame, seq: Column, at: Column) -> DataFrame:
    """Counted hits as increments of the change log."""
    return hits.select(*KEY, seq.cast("bigint").alias("seq"), F.lit("inc").alias("op"), F.col("hits").alias("amount"), at.alias("changed_at"))


def _last(value: Column) -> Column:
    """Latest value that is not null."""
    return F.max(F.when(value.isNotNull(), F.struct(F.col("seq"), value.alias("v"))))["v"]


def counter_state(changes: DataFrame) -> DataFrame:
    """Current counters from the log of set, inc and delete changes.

    A set without amount keeps the value; an inc creates a missing counter; a
    delete wipes everything before it.  Two aggregates with a join on the few
    counters between them: no counter's log is gathered in one place.
    """
    for name in TEXT_FIELDS + ["changed_at"]:
        if name not in changes.columns:
            kind = {"is_public": "boolean", "changed_at": "timestamp"}.get(name, "string")
            changes = changes.withColumn(name, F.lit(None).cast(kind))
    seq, op = F.col("seq"), F.col("op")
    resets = changes.groupBy(*KEY).agg(
        F.max(F.when(op == "delete", seq)).alias("deleted"),
        F.max(F.when((op == "set") & F.col("amount").isNotNull(), seq)).alias("assigned"),
    )
    live = changes.join(resets, KEY).where((op != "delete") & (F.col("deleted").isNull() | (seq > F.col("deleted"))))
    counted = F.when((op == "set") & (seq == F.col("assigned")), F.col("amount")).when(
        (op == "inc") & (F.col("assigned").isNull() | (seq > F.col("assigned"))), F.coalesce("amount", F.lit(1))
    )
    return live.groupBy(*KEY).agg(
        F.coalesce(F.sum(counted), F.lit(0)).cast("bigint").alias("counter_value"),
        *[_last(F.col(name)).alias(name) for name in TEXT_FIELDS if name != "is_public"],
        F.coalesce(_last(F.col("is_public")), F.lit(False)).alias("is_public"),
        F.min("changed_at").alias("created_at"),
        F.max("changed_at").alias("updated_at"),
        F.max("seq").alias("seq"),
    )


def list_counters(
    counters: DataFrame, project_id: str, only_public: bool = False, key: str | None = None
) -> DataFrame:
    """Counters of a project, latest change first, or a single one."""
    rows = counters.where(F.col("project_id") == clean_project_id(project_id))
    if only_public:
        rows = rows.where(F.col("is_public"))
    if key is not None:
        rows = rows.where(F.col("counter_key") == key)
    columns = ["counter_key", "counter_value", "display_name", "unit", "event_trigger", "is_public", "description", "updated_at"]
    return rows.select(*columns).orderBy(F.desc("updated_at"), "counter_key")


def language(accept_language: str | None) -> str:
    """First language of the header, without its region."""
    if not (accept_language or "").strip():
        return "zh"
    return accept_language.split(",")[0].split("-")[0].lower()


def localized(document: Column, lang: str) -> Column:
    """Text for a language, else zh, else en, else the first one there is."""
    texts = as_text_map(document)
    # A member that is JSON null still counts and reads as the word null.
    picks = [
        F.when(F.map_contains_key(texts, F.lit(name)), F.coalesce(F.element_at(texts, F.lit(name)), F.lit("null")))
        for name in dict.fromkeys((lang, "zh", "en"))
    ]
    plain = F.when(F.ltrim(document).startswith('"'), F.get_json_object(document, "$"))
    return F.coalesce(plain, *picks, F.get(F.map_values(texts), F.lit(0)), F.lit(""))


def public_counters(counters: DataFrame, project_id: str, accept_language: str | None = None) -> DataFrame:
    """Public counters with their texts in the reader's language."""
    lang = language(accept_language)
    return list_counters(counters, project_id, only_public=True).select(
        "counter_key",
        "counter_value",
        localized(F.col("display_name"), lang).alias("display_name"),
        localized(F.col("unit"), lang).alias("unit"),
        "updated_at",
    )
