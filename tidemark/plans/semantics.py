"""What columns mean: roles, candidates for a term, families, proposals of a language model."""

from __future__ import annotations

import json
import re

ROLES = ("latitude", "longitude", "identifier", "entity_name", "timestamp", "none")
PATTERNS = {
    "latitude": re.compile(r"^(?:.*_)?lat(?:itude)?(?:_deg)?$", re.I),
    "longitude": re.compile(r"^(?:.*_)?(?:lon|lng|long)(?:itude)?(?:_deg)?$", re.I),
    "identifier": re.compile(r"^(?:mmsi|imo|.*_id|id|entity)$", re.I),
    "entity_name": re.compile(r"^(?:.*_)?name$", re.I),
    "timestamp": re.compile(r"^(?:timestamp|ts|time|t)$", re.I),
}


def columns_by_role(columns: list[str], fields: dict[str, dict], role: str) -> list[str]:
    """Columns whose semantics give the role; by their names where no semantics do."""
    known = [c for c in columns if fields.get(c, {}).get("role") == role]
    return known or [c for c in columns if PATTERNS.get(role) and PATTERNS[role].match(c) and fields.get(c, {}).get("role") in (None, "", role)]


def plain(text: str) -> str:
    return re.sub(r"[^a-z0-9]", "", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", " ", text).lower())


def candidates(term: str, signals: list[str]) -> list[str]:
    """Signals whose name holds the term or is held by it, letters and digits alone compared."""
    want = plain(term)
    return [s for s in signals if want and (want in plain(s) or plain(s) in want)]


def resolve_signal(term: str, signals: list[str], fields: dict[str, dict] | None = None, provider=None) -> str | None:
    """Exact name, else the model's choice, else the one candidate by name, else by description, else the closest spelling."""
    import difflib

    exact = [s for s in signals if plain(s) == plain(term)]
    if exact:
        return exact[0]
    if provider is not None and getattr(provider, "synthesizes", False):
        answer = provider.complete("Answer with one name from the list, or none.", f"{term}\n" + "\n".join(signals)).strip()
        if answer in signals:
            return answer
    some = candidates(term, signals) or [s for s in signals if term.lower() in (fields or {}).get(s, {}).get("description", "").lower()]
    if len(some) == 1:
        return some[0]
    close = difflib.get_close_matches(plain(term), [plain(s) for s in signals], 1, 0.75)
    return next((s for s in signals if close and plain(s) == close[0]), None) if not some else None


def resolve_aggregation(signal: str, fields: dict[str, dict], default: str = "avg") -> tuple[str, str]:
    known = fields.get(signal, {})
    return known.get("aggregation") or default, known.get("unit") or ""


def rates(fields: dict[str, dict]) -> list[str]:
    """Fields that are rates to be integrated."""
    return sorted(f for f, k in fields.items() if k.get("aggregation") == "integral")


def family(term: str, signals: list[str], fields: dict[str, dict]) -> list[str]:
    """Signals a term stands for together: those it names or describes, of the unit most of them share."""
    some = candidates(term, signals) + [s for s in signals if s not in candidates(term, signals) and term.lower() in fields.get(s, {}).get("description", "").lower()]
    units = [fields.get(s, {}).get("unit") or "" for s in some]
    most = max(units, key=lambda u: (units.count(u), u), default="")
    return [s for s, u in zip(some, units, strict=True) if u == most]


def salvage(text: str) -> list[dict]:
    """The whole objects of a JSON array that may be cut off or wrapped in prose."""
    out, decoder, at = [], json.JSONDecoder(), 0
    while (at := text.find("{", at)) >= 0:
        try:
            value, at = decoder.raw_decode(text, at)
            if isinstance(value, dict):
                out.append(value)
        except ValueError:
            at += 1
    return out


def describe_fields(columns: list[str], provider, knowledge, source: str) -> list[dict]:
    """Proposals of a model for the columns' semantics, cleaned and kept as proposed."""
    reply = provider.complete("For each column give JSON objects with field, description, unit, aggregation, role, confidence.", "\n".join(columns))
    made = []
    for p in salvage(reply):
        if p.get("field") in columns:
            made.append(knowledge.set_field(source, p["field"], description=str(p.get("description") or ""), unit=str(p.get("unit") or ""), aggregation=p.get("aggregation") or "avg", role=p.get("role") if p.get("role") in ROLES else "none", confidence=p.get("confidence") or "low"))
    return made
