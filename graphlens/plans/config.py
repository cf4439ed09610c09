"""Traversal configuration and metric views, as plain values that become columns."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class TraversalConfig:
    """What to follow. Decisions are True (follow) or False.

    force_dynamic: type key -> {"default": branches, "overrides": {edge name: {"branches": branches, "decision": bool}}},
    where branches is ("include" | "exclude", list). label_predicates: (label, value, contains, decision) in the order
    in which they apply. tiers: names with the tags and dynamic type keys that move to them. message_of: the ids of the messages of
    single entries, by (rule, entry): ("force_node", name), ("force_edge", from, to), ("force_tagged", tag), ("force_dynamic", type key, edge name)
    or ("label", place among the predicates). messages: texts by id.
    """

    force_nodes: dict[str, bool] = field(default_factory=dict)
    force_edges: dict[tuple[str, str], bool] = field(default_factory=dict)
    force_tagged: dict[str, bool] = field(default_factory=dict)
    force_dynamic: dict[str, dict] = field(default_factory=dict)
    label_predicates: tuple[tuple[str, str, bool, bool], ...] = ()
    tiers: tuple[tuple[str, tuple[str, ...], tuple[str, ...]], ...] = ()
    max_tier: int | None = None
    message_of: dict[tuple, str] = field(default_factory=dict)
    messages: dict[str, str] = field(default_factory=dict)

    @staticmethod
    def from_json(doc: dict | None) -> TraversalConfig:
        """Read the document form; sections that are absent or null are empty."""
        doc = doc or {}
        yes = lambda d: bool(d["include"])
        branches = lambda b: (next(iter(b)).lower(), list(next(iter(b.values())))) if b else None
        tiers = ((doc.get("tiered_traversal") or {}).get("AscendingTiers")) or {}
        dynamic = {
            key: {
                "default": branches(c.get("default_branches")),
                "overrides": {n: {"branches": branches(o.get("branches")), "decision": None if o.get("decision") is None else yes(o["decision"])} for n, o in (c.get("overrides") or {}).items()},
            }
            for key, c in (doc.get("force_dynamic") or {}).items()
        }
        labels = doc.get("label_predicates") or {}
        ordered = [p for _, p in sorted(labels.items())]
        decisions = {("force_node", n): d for n, d in (doc.get("force_nodes") or {}).items()}
        decisions |= {("force_edge", a, b): d for a, to in (doc.get("force_edges") or {}).items() for b, d in to.items()}
        decisions |= {("force_tagged", t): d for t, d in (doc.get("force_tagged") or {}).items()}
        decisions |= {("force_dynamic", key, n): o.get("decision") for key, c in (doc.get("force_dynamic") or {}).items() for n, o in (c.get("overrides") or {}).items()}
        decisions |= {("label", k): p["decision"] for k, p in enumerate(ordered)}
        return TraversalConfig(
            {n: yes(d) for n, d in (doc.get("force_nodes") or {}).items()},
            {(a, b): yes(d) for a, to in (doc.get("force_edges") or {}).items() for b, d in to.items()},
            {t: yes(d) for t, d in (doc.get("force_tagged") or {}).items()},
            dynamic,
            tuple((p["label_name"], p["label_value"], bool(p["contains"]), yes(p["decision"])) for p in ordered),
            tuple((t["name"], tuple(t.get("tags_that_transition_to_this_tier") or ()), tuple(t.get("dynamic_type_keys_that_transition_to_this_tier") or ())) for t in tiers.get("tiers") or ()),
            tiers.get("max_tier"),
            {entry: d["message_id"] for entry, d in decisions.items() if d and d.get("message_id")},
            dict(doc.get("messages") or {}),
        )


#: How the kinds of views are written after, or in place of, the name of a metric.
VIEWS = {"transitive": "~transitive", "dominated": "~dominated", "parents": "parents-count", "count_transitive": "node-count~transitive", "count_dominated": "node-count~dominated", "tier": "tier"}


@dataclass(frozen=True)
class MetricView:
    """A metric as it is shown: itself, summed over what a node reaches or dominates, or up to a tier; or a count.

    Written as metric, metric~transitive, metric~dominated, metric#tier, metric#tier~dominated, or in the older forms metric~tier and
    metric~dominated~tier; counts as VIEWS says. A side of a comparison, or its difference, follows an at sign (@left, @delta; @right is the same as none).
    """

    metric: str
    kind: str = "self"
    tier: str | None = None
    side: str | None = None

    def __str__(self) -> str:
        tail = {"self": "", "tiered": f"#{self.tier}", "tiered_dominated": f"#{self.tier}~dominated"} | VIEWS
        return f"{self.metric}{tail[self.kind]}" + (f"@{self.side}" if self.side else "")

    @staticmethod
    def parse(text: str) -> MetricView:
        body, at, side = text.partition("@")
        if at and side not in ("left", "right", "delta"):
            raise ValueError(f"unknown side: {side}")
        side = side if side in ("left", "delta") else None
        whole = {written: kind for kind, written in VIEWS.items() if not written.startswith("~")}
        if body in whole:
            return MetricView("", whole[body], None, side)
        metric, tiered, rest = body.partition("#")
        tier, *parts = rest.split("~") if tiered else (None, *body.split("~")[1:])
        metric = metric if tiered else body.split("~")[0]
        if metric == "node-count" or not metric or "" in parts or tier == "":
            raise ValueError(f"not a metric view: {text}")
        match parts:
            case []:
                return MetricView(metric, "tiered" if tiered else "self", tier, side)
            case ["dominated"]:
                return MetricView(metric, "tiered_dominated" if tiered else "dominated", tier, side)
            case ["transitive"] if not tiered:
                return MetricView(metric, "transitive", None, side)
            case ["dominated", older] if not tiered:
                return MetricView(metric, "tiered_dominated", older, side)
            case [older] if not tiered:
                return MetricView(metric, "tiered", older, side)
        raise ValueError(f"not a metric view: {text}")
