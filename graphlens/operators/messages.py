"""Why an edge is followed or not: the message of the rule that decided, with its places filled in."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphlens.plans.config import TraversalConfig

from .rules import LITERALS

#: The ids and texts of the messages of each rule, by what it decided (True: followed).
MESSAGES = {
    ("force_node", False): ("node_force_excluded", "This edge was EXCLUDED because the node `%points_to%` was force excluded from the traversal using `force_nodes` config."),
    ("force_node", True): ("node_force_included", "This edge was INCLUDED because the node `%points_to%` was force included from the traversal using `force_nodes` config."),
    ("force_edge", False): ("edge_force_excluded", "This edge from `%points_from%` to `%points_to%` was EXCLUDED because it was force excluded from the traversal using `force_edges` config."),
    ("force_edge", True): ("edge_force_included", "This edge from `%points_from%` to `%points_to%` was INCLUDED because it was force included from the traversal using `force_edges` config."),
    ("force_tagged", True): ("force_tagged_included", "This edge was INCLUDED because `force_tagged` config for the tag `%edge_tag%`"),
    ("force_tagged", False): ("force_tagged_excluded", "This edge was EXCLUDED because `force_tagged` config for the tag `%edge_tag%`"),
    ("force_dynamic", True): ("force_dynamic_included", "This edge was INCLUDED because it matched the `force_dynamic` config for type_key `%edge_properties%` on branch `%edge_branch%`."),
    ("force_dynamic", False): ("force_dynamic_excluded", "This edge was EXCLUDED because it matched the `force_dynamic` config for type_key `%edge_properties%` on branch `%edge_branch%`."),
    ("label", True): ("force_labels_included", "This edge was INCLUDED because it contained labels that matched an entry in the `label_predicates` config."),
    ("label", False): ("force_labels_excluded", "This edge was EXCLUDED because it contained labels that matched an entry in the `label_predicates` config."),
    ("max_tier", False): ("edge_excluded_because_greater_than_max_tier", "This edge was EXCLUDED because its tag `%edge_tag%` is transitions to a tier that is greater than the maximum tier configured in the `tiered_traversal` config."),
}

#: Messages that no rule gives by itself, but that entries may name.
OTHERS = {
    "forced_children_of_excluded": "This edge was EXCLUDED because the node `%points_to%` is a child of a node whose children were excluded from the traversal using `force_children_of` config.",
    "forced_children_of_included": "This edge was INCLUDED because the node `%points_to%` is a child of a node whose children were included from the traversal using `force_children_of` config.",
}
#: The columns that tell the entries of a rule apart.
ENTRIES = {"force_node": ("dst",), "force_edge": ("src", "dst"), "force_tagged": ("tag",), "force_dynamic": ("type_key", "edge_name")}


def _switch(of: dict, pick: int) -> Column:
    out = F.lit(None).cast("string")
    for (rule, followed), message in of.items():
        out = F.when((F.col("rule") == rule) & (F.col("excluded") != F.lit(followed)), F.lit(message[pick])).otherwise(out)
    return out


def message_id() -> Column:
    """The id of the message of a judged edge (src, dst, tag, ..., excluded, rule); null where no rule spoke."""
    return _switch(MESSAGES, 0)


def rendered(own: dict[str, str] | None = None) -> Column:
    """The message of a judged edge. ``own`` texts by id stand in for those of the rules."""
    of = {k: (name, (own or {}).get(name, text)) for k, (name, text) in MESSAGES.items()}
    return _filled(_switch(of, 1))


def _filled(text: Column) -> Column:
    """The text with its places filled in; what is null fills in as empty."""
    of = lambda c: F.coalesce(F.col(c), F.lit(""))
    out = F.replace(F.replace(text, F.lit("%points_from%"), F.col("src")), F.lit("%points_to%"), F.col("dst"))
    properties = F.concat(F.lit("type_key="), of("type_key"), F.lit(", edge_name="), of("edge_name"))
    tagged = F.replace(out, F.lit("%edge_tag%"), of("tag"))
    dynamic = F.replace(F.replace(out, F.lit("%edge_branch%"), of("branch")), F.lit("%edge_properties%"), properties)
    return F.when(F.col("kind") == "tagged", tagged).when(F.col("kind") == "dynamic", dynamic).otherwise(out)


def _by_branch(config: TraversalConfig) -> Column:
    """Whether the branches of an override decide a dynamic edge, though the override has a decision, too."""
    of = [(key, name, o["branches"][1]) for key, c in config.force_dynamic.items() for name, o in (c.get("overrides") or {}).items() if o.get("branches") and o.get("decision") is not None and o["branches"][1]]
    each = [(F.col("type_key") == key) & (F.col("edge_name") == name) & F.col("branch").isin(listed) for key, name, listed in of]
    return F.coalesce(reduce(lambda x, y: x | y, each, F.lit(False)), F.lit(False))


def with_messages(judged: DataFrame, nodes: DataFrame, config: TraversalConfig) -> DataFrame:
    """Judged edges with message_id and message: those that the entry which decided names, where its id is known, or else those of its rule; null where no rule spoke.

    Texts of the configuration stand before built-in ones of the same id. Many entries of a rule are joined, few are literal.
    """
    texts = dict(MESSAGES.values()) | OTHERS | config.messages
    own = F.lit(None).cast("string")
    out, extra = judged, []
    for rule, columns in ENTRIES.items():
        named = [(*entry, name) for (of, *entry), name in config.message_of.items() if of == rule and name in texts]
        if not named:
            continue
        if len(named) > LITERALS:
            extra.append(f"_{rule}")
            known = judged.sparkSession.createDataFrame(named, ", ".join(f"`{c}` string" for c in (*columns, extra[-1])))
            out, found = out.join(known, list(columns), "left"), F.col(extra[-1])
        else:
            pairs = [x for *entry, name in named for x in (F.array(*map(F.lit, entry)), F.lit(name))]
            found = F.element_at(F.create_map(*pairs), F.array(*columns))
        says = (F.col("rule") == rule) & ~_by_branch(config) if rule == "force_dynamic" else F.col("rule") == rule
        own = F.when(says, found).otherwise(own)
    labels = {entry[0]: name for (of, *entry), name in config.message_of.items() if of == "label" and name in texts}
    if labels:
        held = lambda name: F.element_at("labels", name)
        # the last predicate that holds decides; "" if it names no message
        which = [F.when(held(name).isNotNull() & (F.array_contains(held(name), value) == F.lit(contains)), F.lit(labels.get(k, ""))) for k, (name, value, contains, _) in enumerate(config.label_predicates)]
        extra.append("_said")
        said = nodes.select(F.col("node").alias("dst"), F.coalesce(*reversed(which)).alias("_said")).where("_said <> ''")
        out = out.join(said, "dst", "left")
        own = F.when(F.col("rule") == "label", F.col("_said")).otherwise(own)
    out = out.withColumn("message_id", F.coalesce(own, message_id())).drop(*extra)
    every = F.create_map(*[F.lit(x) for pair in texts.items() for x in pair])
    columns = [*judged.columns, "message_id"]
    return out.select(*columns, _filled(F.element_at(every, F.col("message_id"))).alias("message"))
