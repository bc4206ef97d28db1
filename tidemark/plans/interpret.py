"""What a graph of ties may mean: clusters around hubs, a reading of each from a language model, and corrections by people.

Numbers come from the graph alone; a reading is prose, marked as a guess until someone has confirmed or corrected it."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from tidemark.operators.discovery import LEAST_DCOR
from tidemark.plans.provider import Provider
from tidemark.plans.report import edge_words, pretty

MOST_CLUSTERS = 5


def clusters(edges: list[dict], most: int = MOST_CLUSTERS) -> list[dict]:
    """Hubs by the sum of their ties, each with the signals tied to it, strongest first. A report's worth: ``most`` of them.

    Only global and fused ties count; equal hubs come by name."""
    strong = [e for e in edges if e["dcor"] >= LEAST_DCOR and e["scope"] in ("global", "fused")]
    weight: dict[str, float] = {}
    for e in strong:
        for c in (e["a"], e["b"]):
            weight[c] = weight.get(c, 0.0) + e["dcor"]
    out = []
    for hub in sorted(weight, key=lambda c: (-weight[c], c))[:most]:
        ties = sorted((e for e in strong if hub in (e["a"], e["b"])), key=lambda e: (-e["dcor"], e["a"], e["b"]))
        out.append({"hub": hub, "weight": round(weight[hub], 4), "members": [e["b"] if e["a"] == hub else e["a"] for e in ties], "ties": ties})
    return out


def interpret(source: str, edges: list[dict], provider: Provider, context: str = "") -> list[dict]:
    """The clusters with a ``reading`` each and its ``status``: 'guess', or 'none' where the model has nothing to say. Models are asked side by side."""
    found = clusters(edges)

    def read(c: dict) -> str:
        facts = "\n".join(edge_words(e) for e in c["ties"][:10])
        return provider.complete(f"Say in a sentence what these ties of {pretty(c['hub'])} on {source} may mean. Invent no numbers.\n{context}", facts).strip()

    with ThreadPoolExecutor(max_workers=max(1, len(found))) as pool:
        readings = list(pool.map(read, found))
    return [c | {"reading": r, "status": "guess" if r else "none"} for c, r in zip(found, readings, strict=True)]


def correct(readings: list[dict], hub: str, text: str | None, knowledge=None, source: str = "") -> list[dict]:
    """The readings with that of a hub confirmed (no text) or replaced; a replacement is kept as knowledge too. An unknown hub is a KeyError."""
    if hub not in {c["hub"] for c in readings}:
        raise KeyError(hub)
    if text and knowledge is not None:
        knowledge.add("correction", f"{source}: {pretty(hub)}: {text}")
    return [c if c["hub"] != hub else c | ({"reading": text, "status": "corrected"} if text else {"status": "confirmed"}) for c in readings]


def in_words(readings: list[dict]) -> str:
    return "\n".join(f"- {pretty(c['hub'])}, tied to {', '.join(map(pretty, c['members'][:6]))}" + (f": {c['reading']} ({c['status']})" if c["reading"] else "") for c in readings) or "No ties stand out."
