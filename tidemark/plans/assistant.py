"""Questions in words, routed to operators. It decides which one answers and never computes a number itself."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tidemark.functions.expr import bucket_seconds
from tidemark.operators import aggregates, anomaly, discovery, spatial, timejoin, trajectory
from tidemark.plans import interpret, report, semantics
from tidemark.plans.provider import Provider, Stub
from tidemark.plans.stores import Actors, Ambiguous, Knowledge, Watches
from tidemark.plans.timephrase import instant
from tidemark.plans.watching import recent_dates
from tidemark.sources import layout
from tidemark.sources.sinks import Artifacts

INTENTS = (
    "capabilities", "describe_fields", "value", "trend", "plot", "relationship", "reasoning", "correction", "position", "nearby", "voyage",
    "efficiency", "distance", "between", "geo", "anomaly", "summarize", "regimes", "actors", "watches", "smalltalk",
)
#: Words that settle an intent without a model, most telling first.
CUES = (
    ("coverage", r"\bcoverage\b|\bup ?time\b|report(?:ed|ing)? data|\bno data\b"),
    ("watches", r"\bwatch(?:es|ing)?\b|\balert (?:me|us)\b|\bmonitor\b"),
    ("actors", r"\bcrew\b|\bwho (?:is|are)\b|\bnotify\b|\bactors?\b"),
    ("correction", r"\bactually\b|\bthat'?s wrong\b|\bcorrection\b"),
    ("voyage", r"\bvoyages?\b|\btrips?\b|\blegs?\b"),
    ("efficiency", r"\bper (?:\d+ ?)?(?:km|kilomet\w+|nautical mile|nm|hour|mile)\b|\befficien\w+"),
    ("nearby", r"\bnear(?:by)?\b|\bclose to\b|\baround (?:us|me)\b|\bships? around\b"),
    ("between", r"\bdistance (?:between|from)\b"),
    ("distance", r"\bhow far\b|\bdistance\b|\btravel\w*"),
    ("position", r"\bwhere\b|\bposition\b|\blocation\b"),
    ("geo", r"\bwhich area\b|\bby location\b|\bon the map\b"),
    ("plot", r"\bplot\b|\bchart\b|\bgraph\b|\bscatter\b"),
    ("trend", r"\btrend\b|\bover time\b|\bcompared? (?:to|with)\b|\blately\b"),
    ("anomaly", r"\banomal\w+|\bunusual\b|\bdrift\b|\bwrong with\b|\babnormal\b"),
    ("regimes", r"\bregimes?\b|\boperating modes?\b"),
    ("relationship", r"\brelat\w+|\bcorrelat\w+|\bdepend\w+"),
    ("describe_fields", r"\bfields?\b|\bwhat does .* mean\b"),
    ("capabilities", r"\bwhat can (?:you|i)\b|\bcapab\w+|\bavailable\b|\bhelp\b"),
    ("summarize", r"\bsummar\w+|\boverview\b"),
    ("value", r"\baverage\b|\bavg\b|\bmean\b|\bmax(?:imum)?\b|\bmin(?:imum)?\b|\btotal\b|\bmedian\b|\blatest\b|\bhow (?:much|many)\b"),
    ("reasoning", r"\bwhy\b|\bexplain\b"),
)
OUTSIDE = ("film", "movie", "recipe", "weather forecast", "joke", "poem", "stock", "crypto", "song", "sport", "president", "translate")
MODES = {"general": "general", "simple": "general", "analyst": "analyst", "data": "analyst", "expert": "expert", "engineer": "expert"}
AGGS = (
    (r"\bavg\b|\baverage\b|\bmean\b", "avg"), (r"\bmedian\b", "median"), (r"\bmax(?:imum)?\b", "max"), (r"\bmin(?:imum)?\b", "min"), (r"\btotal\b|\bsum\b", "sum"), (r"\blatest\b", "latest"),
    (r"\bdeviation\b", "stddev"), (r"\bcount\b|\bhow many\b", "count"), (r"\bintegra(?:l|ted)\b", "integral"),
)


class Clarify(Exception):
    """An ambiguity that only the person asking can settle."""


def in_scope(message: str) -> bool:
    """Whether a message may be about the asset: no word of it, taken whole, is of another domain."""
    return not any(re.search(rf"\b{re.escape(w)}s?\b", message.lower()) for w in OUTSIDE)


def intent_of(message: str, provider: Provider) -> str:
    """The intent that a word settles, else the label a model answers with, else smalltalk for a few words and reasoning for more."""
    text = message.lower()
    for name, pattern in CUES:
        if re.search(pattern, text):
            return name
    reply = provider.complete("Answer with one label: " + ", ".join(INTENTS), message).strip().lower()
    return reply if reply in INTENTS else "smalltalk" if len(text.split()) <= 3 else "reasoning"


def mode_switch(message: str) -> str | None:
    """The presentation asked for: needs a verb of switching and the name of a mode."""
    m = re.search(r"\b(?:switch|change|set|go)\b.*\b(" + "|".join(MODES) + r")\b", message.lower())
    return MODES[m[1]] if m else None


class Assistant:
    """One conversation about an asset's sources. ``frames`` maps a source to its rows (with a ``timestamp`` in seconds)."""

    def __init__(self, frames: dict, provider: Provider | None = None, knowledge: Knowledge | None = None, actors: Actors | None = None, watches: Watches | None = None, artifacts: Artifacts | None = None, places: list[dict] | None = None, mode: str = "general"):
        self.frames, self.provider = frames, provider or Stub()
        self.knowledge, self.actors, self.watches = knowledge or Knowledge(), actors or Actors(), watches or Watches()
        self.artifacts, self.places, self.mode = artifacts, places or [], mode
        self.source = next(iter(frames), None)
        self.waiting: str | None = None
        self.last: tuple[str, str] | None = None
        self._ranges: dict[str, tuple[float, float]] = {}
        self.offered: list[str] = []  # sources whose findings a "yes" asks for

    # --- a turn

    def send(self, message: str) -> str:
        if switched := mode_switch(message):
            self.mode = switched
            return f"Answers are now for {switched} readers."
        if self.waiting:
            message, self.waiting = f"{self.waiting} {message}", None
        if not in_scope(message):
            return "I answer questions about this asset's data."
        if re.fullmatch(r"\W*why\W*", message.lower()) and self.last:
            return self.reasoning(self.last[0])
        if self.offered and re.fullmatch(r"\W*(?:yes|yep|sure|ok(?:ay)?|please|go on|show me)(?: please)?\W*", message.lower()):
            answer = self.anomaly_detail(message)
            self.last = (message, answer)
            return answer
        intent = intent_of(message, self.provider)
        self.source = self.route(intent, message)
        self.offered = []
        try:
            # the registries are attributes, so the answers for these intents have names of their own
            answer = getattr(self, f"answer_{intent}" if intent in ("watches", "actors") else intent)(message)
        except Clarify as question:
            self.waiting = message
            return str(question)
        self.last = (message, answer)
        return answer

    # --- finding what is meant

    def named_source(self, message: str) -> str | None:
        text = message.lower()
        return next((s for s in sorted(self.frames, key=len, reverse=True) if s.lower() in text or s.lower().replace("-", " ") in text), None)

    def route(self, intent: str, message: str) -> str | None:
        """The source that can answer: the one named; for places and movement one with positions; for numbers the only one whose signals the
        message names; for drift the only one with a baseline; else the present one."""
        if named := self.named_source(message):
            return named
        if intent in ("position", "distance", "voyage") and self.source and not self.places_of(self.source):
            return next((s for s in self.frames if self.places_of(s)), self.source)
        if intent in ("value", "trend", "plot", "efficiency", "geo"):
            grams = {semantics.plain(w) for w in re.findall(r"[A-Za-z0-9_]+", message) if len(w) > 3}
            some = [s for s in self.frames if any(semantics.plain(c) in grams for c in self.signals(s))]
            return some[0] if len(some) == 1 else self.source
        if intent == "anomaly" and self.artifacts and not self.all_sources(message) and not self.artifacts.load("baseline", self.source):
            some = [s for s in self.frames if self.artifacts.load("baseline", s)]
            return some[0] if len(some) == 1 else self.source
        return self.source

    def places_of(self, source: str) -> tuple[str, str] | None:
        """A source's columns of latitude and longitude."""
        lat, lon = self.role(source, "latitude"), self.role(source, "longitude")
        return (lat, lon) if lat and lon else None

    def all_sources(self, message: str) -> bool:
        return not self.named_source(message) and bool(re.search(r"\b(?:all|every|each|any) (?:sources?|of (?:it|them))\b|\bacross\b|\bmy data\b|\banywhere\b", message.lower()))

    def signals(self, source: str) -> list[str]:
        return layout.signals_of(self.frames[source])

    def signal_in(self, message: str) -> tuple[str, str]:
        """(source, signal) that the message names; asks if several fit equally, raises if none does."""
        order = [self.source, *(s for s in self.frames if s != self.source)]
        words = re.findall(r"[A-Za-z0-9_]+", message)
        grams = sorted({"".join(words[i : i + n]) for n in (4, 3, 2, 1) for i in range(len(words) - n + 1)}, key=len, reverse=True)
        for s in order:
            exact = [c for g in grams for c in self.signals(s) if semantics.plain(c) == semantics.plain(g)]
            if exact:
                return s, exact[0]
        for s in order:
            for g in grams:
                some = [c for c in self.signals(s) if len(g) > 3 and semantics.plain(g) in semantics.plain(c)]
                if len(some) == 1:
                    return s, some[0]
                if some:
                    raise Clarify(f"Which one do you mean: {', '.join(some)}?")
        raise Clarify(f"Which signal? {self.source} has {', '.join(self.signals(self.source))}.")

    def role(self, source: str, role: str) -> str | None:
        found = semantics.columns_by_role(self.frames[source].columns, self.knowledge.fields(source), role)
        return found[0] if found else None

    def position_source(self, several: bool = False) -> tuple[str, str, str] | None:
        """A source with positions: the own one, or with ``several`` one that reports many entities."""
        for s, df in self.frames.items():
            lat, lon = self.role(s, "latitude"), self.role(s, "longitude")
            if lat and lon:
                who = self.role(s, "identifier")
                many = bool(who) and (layout.distinct_count(df, who).first()[0] or 0) > 1
                if many == several:
                    return s, lat, lon
        return None

    def range_of(self, source: str) -> tuple[float, float]:
        if source not in self._ranges:
            r = layout.time_range(self.frames[source]).first()
            self._ranges[source] = (r[0] or 0.0, r[1] or 0.0)
        return self._ranges[source]

    def track(self):
        if not (found := self.position_source()):
            raise Clarify("No source has positions. Which columns are latitude and longitude?")
        s, lat, lon = found
        return spatial.fixes(self.frames[s], lat, lon)

    def others(self):
        if not (found := self.position_source(several=True)):
            raise Clarify("No source reports other entities.")
        s, lat, lon = found
        name = self.role(s, "entity_name")
        df = self.frames[s]
        return df.select(F.col(self.role(s, "identifier")).cast("string").alias("id"), F.col("timestamp").alias("t"), F.col(lat).alias("lat"), F.col(lon).alias("lon"), (F.col(name) if name else F.lit(None).cast("string")).alias("name"))

    # --- answers

    def value(self, message: str) -> str:
        source, signal = self.signal_in(message)
        fields = self.knowledge.fields(source)
        agg, unit = semantics.resolve_aggregation(signal, fields)
        agg = next((a for cue, a in AGGS if re.search(cue, message.lower())), agg)
        if agg == "sum" and fields.get(signal, {}).get("aggregation") == "integral":
            agg = "integral"
        if agg == "latest":
            r = aggregates.latest(self.frames[source], [signal]).first()
            return f"{signal}: {r['value']} {unit} at {layout.epoch_text(r['timestamp'])}" if r["value"] is not None else f"{signal} has no reading."
        r = aggregates.aggregate(self.frames[source], signal, agg, unit).first()
        return f"{agg} of {signal}: {r['value']:.4g} {r['unit']} ({r['n_rows']} rows)".replace(" ()", "") if r["value"] is not None else f"{signal} has no reading."

    def trend(self, message: str) -> str:
        source, signal = self.signal_in(message)
        if "date" in self.frames[source].columns and re.search(r"compar|lately|recent", message.lower()):
            r = aggregates.compare_trend(self.frames[source], signal).first()
            return f"{signal} is {r['direction']}: {r['recent']:.4g} against {r['prior']:.4g} before ({r['pct']:+.1f} %)"
        bucket = bucket_seconds(next((w for w in ("minute", "day") if w in message.lower()), "hour"))
        r = aggregates.series(self.frames[source], signal, bucket).agg(F.count("*").alias("n"), F.min_by("value", "bucket").alias("a"), F.max_by("value", "bucket").alias("b")).first()
        return f"{signal} over {r['n']} buckets of {bucket:g} s: from {r['a']:.4g} to {r['b']:.4g}"

    def plot(self, message: str) -> str:
        return "Series ready: " + self.trend(message)

    def capabilities(self, message: str) -> str:
        out = []
        for s in self.frames if self.all_sources(message) else [self.source]:
            rows = [r.asDict() for r in aggregates.capabilities(self.frames[s]).collect()]
            usable, rest = [r for r in rows if r["usable"]], [r for r in rows if not r["usable"]]
            out.append(f"{s}: " + ", ".join(f"{r['signal']} ({r['min']:g} to {r['max']:g})" for r in usable) + "".join(f"; not {r['signal']} ({r['reason']})" for r in rest))
            out += [f"  try: {q}" for q in aggregates.example_requests(rows)]
        return "\n".join(out)

    def describe_fields(self, message: str) -> str:
        made = semantics.describe_fields(self.frames[self.source].columns, self.provider, self.knowledge, self.source)
        known = self.knowledge.fields(self.source)
        return "\n".join(f"{f}: {k.get('description', '')} [{k.get('unit', '')}] {k['status']}" for f, k in sorted(known.items())) or f"Nothing is known about the fields of {self.source} ({len(made)} proposals)."

    def position(self, message: str) -> str:
        phrase = instant(message, *self.range_of(next(iter(self.frames))))[0]
        if m := re.search(r"\bwhere (?:was|is) (?:the )?([\w-]+)", message.lower()):
            if self.position_source(several=True) and m[1] not in ("we", "i", "it", "ship", "vessel", "asset"):
                at = phrase or self.range_of(self.position_source(several=True)[0])[1]
                r = spatial.entity_position(self.others(), m[1], at).first()
                if r:
                    return f"{r['name'] or r['id']}: {spatial.place_label(r['lat'], r['lon'])} at {layout.epoch_text(r['t'])}"
        track = self.track()
        r = timejoin.nearest_at(track, phrase, 3600, "t").first() if phrase else spatial.current_position(track, "lat", "lon", "t").first()
        if r is None:
            return "There is no fix near that time."
        p = spatial.nearest_place(track.sparkSession.createDataFrame([(r["lat"], r["lon"])], "lat double, lon double"), self.places).first()
        return f"{spatial.place_label(r['lat'], r['lon'], p['place'], p['place_km'])} at {layout.epoch_text(r['t'])}"

    def nearby(self, message: str) -> str:
        at = instant(message, *self.range_of(self.position_source()[0]))[0] or self.range_of(self.position_source()[0])[1] if self.position_source() else 0.0
        if m := re.search(r"every (\d+(?:\.\d+)?) ?km", message.lower()):
            rows = spatial.nearby_new(self.track(), self.others(), float(m[1])).orderBy("segment").collect()
            return "\n".join(f"{r['km_start']:g} to {r['km_end']:g} km: {r['new_count']} new" for r in rows) + "\n(looked for at three moments of each stretch)"
        rows = spatial.nearby(self.track(), self.others(), at, name="name").orderBy("distance_km", "id").limit(8).collect()
        return "\n".join(f"{r['name'] or r['id']}: {r['distance_km']} km" for r in rows) or "Nobody was near."

    def distance(self, message: str) -> str:
        return f"{spatial.track_distance(self.track(), 'lat', 'lon', 't').first()[0]} km travelled"

    def between(self, message: str) -> str:
        named = [p for p in self.places if p["name"].lower() in message.lower()]
        if len(named) < 2:
            raise Clarify("Between which two known places?")
        a, b = named[:2]
        km = trajectory.km_from(a["lat"], a["lon"], trajectory.np.array([b["lat"]]), trajectory.np.array([b["lon"]]))[0]
        return f"{a['name']} to {b['name']}: {km:.3f} km"

    def voyage(self, message: str) -> str:
        named = [p for p in self.places if p["name"].lower() in message.lower()]
        track = self.track()
        if len(named) >= 2:
            r = spatial.voyage_window(track, (named[0]["lat"], named[0]["lon"]), (named[1]["lat"], named[1]["lon"]), "lat", "lon", "t").first()
            if r is None:
                return "No voyage matches."
            text = f"{named[0]['name']} to {named[1]['name']}: {r['track_km']} km in {(r['arrival_t'] - r['departure_t']) / 3600:.1f} h"
            rate = [(s, f) for s in self.frames for f in semantics.rates(self.knowledge.fields(s)) if f in self.frames[s].columns]
            if rate and re.search(r"fuel|consum|used|burn", message.lower()):
                s, f = rate[0]
                v = aggregates.integral(self.frames[s], f, self.knowledge.fields(s)[f].get("unit", ""), t_range=(r["departure_t"], r["arrival_t"])).first()
                text += f"; {v['value'] or 0:.1f} {v['unit']} of {f}"
            return text
        rows = trajectory.detect_legs(track, None, self.places).orderBy("leg").collect()
        return "\n".join(f"leg {r['leg']}: {r['km']} km in {r['duration_h']} h" for r in rows) or "No legs."

    def efficiency(self, message: str) -> str:
        source, signal = self.signal_in(message)
        per = 20.0 if "20" in message else 1.0
        track = self.track().withColumnRenamed("t", "timestamp")
        r = spatial.efficiency(self.frames[source], track, signal, "lat", "lon", per, self.knowledge.fields(source).get(signal, {}).get("unit", "")).first()
        return f"{r['efficiency']:.4g} {r['unit']} of {signal} per {per:g} km" if r["efficiency"] is not None else "There is too little movement to say."

    def geo(self, message: str) -> str:
        source, signal = self.signal_in(message)
        rows = spatial.signal_by_location(self.track(), self.frames[source], [f"`{signal}`"]).orderBy(F.desc("mean"), "lat_cell", "lon_cell").limit(8).collect()
        return "\n".join(f"{r['lat_cell']:.2f}, {r['lon_cell']:.2f}: {r['mean']:.4g} ({r['n']})" for r in rows) or "No fixes have readings."

    def coverage(self, message: str) -> str:
        position = self.track() if self.position_source() else None
        rows = spatial.coverage_gaps(self.frames[self.source], "timestamp", None, position).orderBy(F.desc("duration_s"), "t_start").limit(5).collect()
        if not rows:
            return f"{self.source} has too few readings to tell."
        head = f"{self.source} reported {rows[0]['coverage']:.0%} of the time"
        gaps = [r for r in rows if r["t_start"] is not None][:4]
        return "\n".join([head, *(f"- no data for {r['duration_s'] / 60:.0f} min from {layout.epoch_text(r['t_start'])}" + ("" if r["moving"] is None else ", while moving" if r["moving"] else ", at rest") for r in gaps)])

    def discover(self, source: str) -> dict:
        found = self.artifacts.load("discovery", source) if self.artifacts else None
        if found is None:
            made = discovery.regime_graphs(self.frames[source], self.signals(source))
            found = made | {"edges": [r.asDict() for r in made["edges"].collect()]}
            if self.artifacts:
                self.artifacts.save("discovery", source, found)
        return found

    def regimes(self, message: str) -> str:
        sources = list(self.frames) if self.all_sources(message) else [self.source]
        found = {s: self.discover(s) for s in sources}
        return "\n".join(report.markdown(report.discovery_report(s, f, [])) for s, f in found.items())

    def fused(self, sources: list[str]) -> str:
        """Ties between signals of different sources."""
        made = discovery.fused_graph(timejoin.fuse({s: self.frames[s] for s in sources}))
        strong = F.col("cross") & (F.col("dcor") >= discovery.LEAST_DCOR)
        edges = [r.asDict() for r in made["edges"].where(strong).orderBy(F.desc("dcor"), "a", "b").limit(15).collect()]
        return "\n".join(map(report.edge_words, edges)) or f"No ties between {' and '.join(sources)} stand out."

    def interpretation(self, source: str) -> list[dict]:
        """Readings of a source's clusters, as kept, or made anew."""
        kept = self.artifacts.load("interpretation", source) if self.artifacts else None
        if kept:
            return kept["readings"]
        made = interpret.interpret(source, self.discover(source)["edges"], self.provider, self.knowledge.context())
        if self.artifacts:
            self.artifacts.save("interpretation", source, {"readings": made})
        return made

    def apply_correction(self, source: str, hub: str, text: str | None = None) -> list[dict]:
        """Confirms (without text) or replaces the reading of a hub."""
        made = interpret.correct(self.interpretation(source), hub, text, self.knowledge, source)
        if self.artifacts:
            self.artifacts.save("interpretation", source, {"readings": made})
        return made

    def relationship(self, message: str) -> str:
        named = [s for s in self.frames if s.lower() in message.lower()]
        if len(self.frames) > 1 and (len(named) > 1 or re.search(r"\bacross\b|\bbetween (?:the |all )?sources\b", message.lower())):
            return self.fused(named if len(named) > 1 else list(self.frames))
        edges = sorted(self.discover(self.source)["edges"], key=lambda e: -e["dcor"])
        words = semantics.plain(message)
        named = [e for e in edges if semantics.plain(e["a"]) in words or semantics.plain(e["b"]) in words] or edges
        return "\n".join(report.edge_words(e) for e in named if e["dcor"] >= 0.15 and e["scope"] in ("global", "fused"))[:2000] or "No ties stand out."

    def summarize(self, message: str) -> str:
        found = self.discover(self.source)
        return report.markdown(report.discovery_report(self.source, found, found["edges"]))

    def reasoning(self, message: str) -> str:
        facts = self.knowledge.context()
        if not self.provider.synthesizes:
            return self.relationship(message) + ("\nKnown:\n" + facts if facts else "")
        return self.provider.complete("Explain from these findings alone; invent no numbers.\n" + facts, message + "\n" + self.relationship(message))

    def drift_of(self, source: str) -> dict | None:
        """What departs from the source's baseline in the dates it has not seen, or the last two; None without a baseline."""
        base = self.artifacts.load("baseline", source) if self.artifacts else None
        if not base:
            return None
        df = self.frames[source]
        if "date" in df.columns:
            have = sorted(r[0] for r in df.select(F.col("date").cast("string")).distinct().collect())  # one a day
            df = df.where(F.col("date").cast("string").isin(recent_dates(have, base)))
        return anomaly.detect_drift(df, base)

    def headline(self, source: str, found: dict | None) -> str:
        if found is None:
            return f"{source}: there is no baseline yet; build one over days known to be good."
        joint = sum(1 for r in found["joint"] if r["flagged"])
        parts = [f"{n} {what}{'s' if n > 1 else ''}" for n, what in ((len(found["structure"]), "changed tie"), (len(found["regimes"]), "changed regime"), (len(found["transitions"]), "odd transition"), (joint, "regime with unusual readings")) if n]
        return f"{source}: " + (", ".join(parts) if parts else "nothing departs from the baseline") + f" ({found['rows']} rows)"

    def anomaly(self, message: str) -> str:
        text = message.lower()
        if re.search(r"\bwhy\b|\bexplain\b|\bmean(?:s|ing)?\b|\bcaus\w+", text):
            return self.explain_drift(message)
        if re.search(r"\bdetails?\b|\bin full\b|\bmore about\b", text):
            return self.anomaly_detail(message)
        sources = list(self.frames) if self.all_sources(message) else [self.source]
        found = {s: self.drift_of(s) for s in sources}
        out = [self.headline(s, f) for s, f in found.items()]
        self.offered = [s for s, f in found.items() if f and (f["structure"] or f["regimes"] or f["transitions"] or any(r["flagged"] for r in f["joint"]))]
        if self.offered:
            out.append("Shall I show the details?")
        return "\n".join([*out, *self.behavioral_flags(sources)])

    def anomaly_detail(self, message: str) -> str:
        """The findings in full, of the sources just offered or else the present one."""
        sources, self.offered = self.offered or ([self.source] if not self.all_sources(message) else list(self.frames)), []
        return "\n".join(f"{s}: " + (anomaly.render_drift(f) if (f := self.drift_of(s)) else "there is no baseline.") for s in sources)

    def labelled(self, source: str, name: str) -> str:
        """A signal as people know it: its described meaning, or its name."""
        return self.knowledge.fields(source).get(name, {}).get("description") or report.pretty(name)

    def grounds(self, source: str, found: dict) -> dict:
        """What an explanation may rest on: the findings with their signals' meanings and the facts known; nothing else."""
        regimes = {p["label"]: p for p in found.get("profiles", [])}
        return {
            "source": source,
            "rows": found["rows"],
            "ties": [{"between": [self.labelled(source, c) for c in r["edge"].split("::")], "change": r["kind"], "from": round(r["base"], 2), "to": round(r["window"], 2), "in": r["scope"]} for r in found["structure"][:8]],
            "regimes": [{"regime": r["label"], "change": r["kind"], "from": round(r["base_fraction"], 3), "to": round(r["window_fraction"], 3)} | ({"size": regimes[r["label"]]["size"]} if r["label"] in regimes else {}) for r in found["regimes"][:6]],
            "transitions": [{"from": r["from_label"], "to": r["to_label"], "kind": r["kind"]} for r in found["transitions"][:6]],
            "readings": [{"regime": r["label"], "share": r["fraction"], "led by": [self.labelled(source, t["signal"]) for t in r["top"][:2]]} for r in found["joint"] if r["flagged"]],
            "known": self.knowledge.context(),
        }

    def explain_drift(self, message: str) -> str:
        """What the departures may come from. A model gets the findings alone; without one they are told as they are, and no cause is named."""
        import json

        out = []
        for s in list(self.frames) if self.all_sources(message) else [self.source]:
            found = self.drift_of(s)
            if found is None:
                out.append(self.headline(s, None))
                continue
            grounds = self.grounds(s, found)
            if self.provider.synthesizes:
                out.append(self.provider.complete("Explain these departures to a reader of the kind: " + self.mode + ". Use nothing but what is given, and invent no numbers.", json.dumps(grounds, default=str)))
                continue
            lines = [f"- the tie between {' and '.join(t['between'])} {t['change']}" for t in grounds["ties"]] + [f"- regime {r['regime']}: {r['change'].replace('_', ' ')}" for r in grounds["regimes"]]
            lines += [f"- readings in regime {r['regime']} are unusual together, led by {', '.join(r['led by'])}" for r in grounds["readings"]]
            out.append("\n".join([f"{s}: this is what changed; what caused it the data don't say.", *(lines or ["- nothing"]), *(["Known:", grounds["known"]] if grounds["known"] else [])]))
        return "\n".join(out)

    def behavioral_flags(self, sources: list[str]) -> list[str]:
        """Sentences on present stops that last unusually long, the worst three entities of each source that has positions."""
        out = []
        for s in sources:
            if not (where := self.places_of(s)):
                continue
            who = self.role(s, "identifier")
            df = self.frames[s]
            track = df.select(F.col("timestamp").cast("double").alias("t"), *[F.col(f"`{c}`").cast("double").alias(n) for c, n in zip(where, ("lat", "lon"), strict=True)], (F.col(f"`{who}`").cast("string") if who else F.lit("")).alias("_who"))
            flags = trajectory.dwell_flags(trajectory.detect_stops(track, "_who")).where("flagged").orderBy(F.desc("ratio"), "entity").limit(3).collect()
            out += [f"{s}{' ' + r['entity'] if r['entity'] else ''}: the present stop lasts {r['current_h']:.1f} h, {r['ratio']:.1f} times the usual ({r['confidence']} confidence)." for r in flags]
        return out

    def correction(self, message: str) -> str:
        return f"Noted: {self.knowledge.add('correction', message)['text']}"

    def watch_names(self) -> list[str]:
        return [f"{w['id']}: {w['condition_type']} on {w['source']}" + ("" if w["enabled"] else " (off)") for w in self.watches.all()]

    def answer_watches(self, message: str) -> str:
        if m := re.search(r"\b(above|over|below|under)\s+(-?\d+(?:\.\d+)?)", message.lower()):
            source, signal = self.signal_in(message)
            w = self.watches.add(source, "threshold", {"signal": signal, "aggregation": next((a for c, a in AGGS if re.search(c, message.lower()) and a != "latest"), "avg"), "op": ">" if m[1] in ("above", "over") else "<", "value": float(m[2])}, description=message)
            return f"Watching {signal} on {source} ({w['id']})."
        if re.search(r"anomal|drift", message.lower()):
            return f"Watching {self.source} for drift ({self.watches.add(self.source, 'anomaly', {}, description=message)['id']})."
        return "\n".join(self.watch_names()) or "Nothing is watched."

    def answer_actors(self, message: str) -> str:
        if m := re.search(r"\badd (?:the |a |an )?(?:actor |person )?([\w .'-]+?)(?: as (?:the |a |an )?([\w -]+))?$", message.strip(), re.I):
            made = self.actors.add(m[1], roles=[m[2]] if m[2] else [])
            return f"{made['name']} is on the list."
        try:
            found = self.actors.resolve(re.sub(r".*\bwho (?:is|are) (?:the |our )?", "", message.lower()).strip(" ?")) if "who" in message.lower() else None
        except Ambiguous as several:
            raise Clarify(f"Which one: {several}?") from None
        return f"{found['name']}: {', '.join(found['roles']) or found['kind']}" if found else ", ".join(a["name"] for a in self.actors.all()) or "Nobody is on the list."

    def smalltalk(self, message: str) -> str:
        return "Ask about this asset's data; 'what can you do?' lists it."
