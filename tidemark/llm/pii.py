"""Surrogates for personal data, in DataFrame expressions alone.

Entities are found by pattern. Each distinct entity of the corpus gets a replacement of its own kind, made from a keyed
hash: letters stay letters and digits digits, a card number still passes its check digit, a name keeps its script and
the gender its title tells, and every mention keeps its own punctuation. Replacements are checked
against each other and against all originals, and made anew where they collide, so distinct entities
stay distinct; an entity has the same replacement wherever it is mentioned, however it is punctuated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Carried, pick, written
from tidemark.llm.quality import let

OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
MALE = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Г-н", "Господин", "Κύριος")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Г-жа", "Госпожа", "Κυρία")
NEUTRAL = ("Dr", "Prof", "Professor", "Dra", "Д-р", "Доктор", "Профессор", "Δρ")
TITLE = rf"(?<!\p{{L}})(?:{'|'.join(sorted(MALE + FEMALE + NEUTRAL, key=len, reverse=True))})\.? "
#: An apostrophe is a name's if two letters or more follow: O'Brien, but not the possessive.
NAME = r"\p{Lu}(?:\p{L}|['’](?=\p{L}{2})){1,30}(?:-\p{Lu}\p{L}{1,30})?"
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])",
    "ip": rf"(?<![0-9A-Za-z.])(?:{OCTET}\.){{3}}{OCTET}(?![0-9A-Za-z]|\.[0-9])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "card": r"(?<![0-9A-Za-z+])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-][0-9]{2,4}){1,3}|\+[0-9]{8,15}|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?![0-9A-Za-z])",
    "person": rf"{TITLE}(?:{NAME} ){{0,3}}{NAME}",
}
ANY = "|".join(p for kind, p in PATTERNS.items() if kind != "card")
#: Card numbers stand before phones; those of a text are put in by name, so that digits that only look like one hide nothing.
FIRST, THEN = ("|".join(PATTERNS[k] for k in some) for some in (("email", "ip", "ssn"), ("phone", "person")))
#: Part of a run of digits can be a card if its groups have three digits or more and are parted alike.
GROUPS = r"^[0-9]{3,}(?:([ -])[0-9]{3,}(?:\1[0-9]{3,})*)?$"
#: Syllables that replacement names are made of, by script, and the ends of first names by gender.
SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga go ha hi jo ka ke la le li lo ma me mi na ne no pa ra re ri ro sa se so ta te ti va ve vi wa",
    "cyrillic": "ба бе бо ва ве ви га го да де до за ка ке ла ле ли ло ма ме ми на не но па ра ре ри ро са се со та те ти фа ха",
    "greek": "βα βε γα γο δα δε δο ζα θα κα κε κο λα λε λι λο μα με μι να νε νο πα ρα ρε ρι ρο σα σε σο τα τε τι φα χα",
}
ENDS = {"latin": ("ndo", "lia", "ri"), "cyrillic": ("слав", "лина", "ша"), "greek": ("νος", "λια", "ρι")}
NAMES = ("last", "first_m", "first_f", "first_n")
#: From attempt ``WIDER`` on a number gets one more digit each time, so that its kind never runs out of replacements.
MOST_ATTEMPTS, WIDER = 60, 20
SALTS, USE_SALTS = 16, 64


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """The sum, modulo ten, of a digit string by the rule of card numbers."""
    def part(c: Column, i: Column) -> Column:
        n = c.cast("int")
        return F.when(i % 2 == 0, n).when(n > 4, n * 2 - 9).otherwise(n * 2)

    return F.aggregate(F.transform(F.filter(F.split(F.reverse(d), ""), lambda c: c != ""), part), F.lit(0), lambda s, x: s + x) % 10


def kind_of(m: Column) -> Column:
    """The kind of a match; null for digits that only look like a card; 'name' for a bare name."""
    d = digits(m)
    return (
        F.when(m.contains("@"), F.lit("email"))
        .when(m.rlike(f"^(?:{PATTERNS['person']})$"), F.lit("person"))
        .when(m.rlike(r"^\p{L}"), F.lit("name"))
        .when(m.rlike(f"^(?:{OCTET}\\.){{3}}{OCTET}$"), F.lit("ip"))
        .when(m.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), F.lit("ssn"))
        .when(m.rlike(r"^[0-9]") & (F.length(d) >= 13), F.when(luhn(d) == 0, F.lit("card")))
        .otherwise(F.lit("phone"))
    )


def norm_of(kind: Column, m: Column) -> Column:
    """What is alike in all mentions of an entity."""
    d = digits(m)
    phone = F.when((F.length(d) == 11) & d.startswith("1"), F.substring(d, 2, 10)).otherwise(d)
    return F.when(kind == "email", F.lower(m)).when(kind == "ip", m).when(kind == "phone", phone).otherwise(d)


def names_of(m: Column) -> Column:
    """(kind, name) of the names after a title; the gender is the title's, or none."""
    titled = lambda some: m.rlike(f"^(?:{'|'.join(sorted(some, key=len, reverse=True))})\\.? ")
    first = F.when(titled(FEMALE), F.lit("first_f")).when(titled(NEUTRAL), F.lit("first_n")).otherwise(F.lit("first_m"))
    tokens = F.split(F.regexp_replace(m, f"^{TITLE}", ""), " ")
    return let(tokens, lambda t: F.transform(t, lambda x, i: F.struct(F.when(i < F.size(t) - 1, first).otherwise(F.lit("last")).alias("kind"), F.lower(x).alias("norm"))))


def cards_of(text: Column) -> Column:
    """The card numbers of a text as they are written, longest first: of each run of digits the groups in a row that pass the check digit."""
    runs = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(r"[0-9][0-9 -]{12,}"), F.lit(0)), lambda r: F.split(r, "[ -]{2,}")))

    def windows(run: Column) -> Column:
        def cut(groups: Column) -> Column:
            one = lambda i: F.transform(F.sequence(i, F.least(F.size(groups), i + 18)), lambda j: F.regexp_replace(F.array_join(F.slice(groups, i, j - i + 1), ""), "[ -]$", ""))
            return F.flatten(F.transform(F.sequence(F.lit(1), F.size(groups)), one))

        whole = F.regexp_replace(run, "[ -]$", "")
        some = F.filter(let(F.regexp_extract_all(run, F.lit("[0-9]+[ -]?"), F.lit(0)), cut), lambda w: w.rlike("^[0-9](?:[ -]?[0-9]){12,18}$") & ((w == whole) | w.rlike(GROUPS)))
        return F.filter(some, lambda w: luhn(digits(w)) == 0)

    found = F.array_distinct(F.flatten(F.transform(F.filter(runs, lambda r: F.length(digits(r)) >= 13), windows)))
    return F.transform(F.array_sort(F.transform(found, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), lambda x: x["w"])


def pattern_of(text: Column) -> Column:
    """The pattern of a text's entities, among them its card numbers."""
    literal = lambda c: F.concat(F.lit(rf"{FIRST}|(?<![0-9A-Za-z+])(?:"), F.array_join(c, "|"), F.lit(rf")(?![0-9A-Za-z])|{THEN}"))
    return let(cards_of(text), lambda c: F.when(F.size(c) > 0, literal(c)).otherwise(F.lit(ANY)))


def entities_of(text: Column) -> Column:
    """The distinct (kind, norm) of a text."""
    hits = let(pattern_of(text), lambda p: F.regexp_extract_all(text, p, F.lit(0)))

    def one(m: Column) -> Column:
        return let(kind_of(m), lambda k: F.when(k == "person", names_of(m)).otherwise(F.array(F.struct(k.alias("kind"), norm_of(k, m).alias("norm")))))

    return F.array_distinct(F.filter(F.flatten(F.transform(hits, one)), lambda e: e["kind"].isNotNull()))


def surrogate(key: str, kind: Column, norm: Column, attempt: Column) -> Column:
    """A replacement, by keyed hash; another one for each attempt."""
    h = F.sha2(F.concat_ws("|", F.lit(key), kind, attempt.cast("string"), norm), 512)

    def at(h: Column, i: Column) -> Column:
        return F.conv(F.substr(h, (F.lit(2) * (i % 63) + 1).cast("int"), F.lit(3)), 16, 10).cast("int")

    def scrambled(x: Column, h: Column) -> Column:
        def char(c: Column, i: Column) -> Column:
            letter = F.substr(F.lit("abcdefghijklmnopqrstuvwxyz"), (at(h, i) % 26 + 1).cast("int"), F.lit(1))
            return F.when(c.rlike("^[0-9]$"), (at(h, i) % 10).cast("string")).when(c.rlike("^[a-z]$"), letter).otherwise(c)

        return F.array_join(F.transform(F.split(x, ""), char), "")

    def number(d: Column, h: Column, low_first: int) -> Column:
        def char(c: Column, i: Column) -> Column:
            high = (i == 0) | ((i == 3) & (F.length(d) == 10))
            return F.when(high, (at(h, i) % (10 - low_first) + low_first).cast("string")).otherwise((at(h, i) % 10).cast("string"))

        wide = F.substr(F.repeat(F.lit("0"), MOST_ATTEMPTS), F.lit(1), F.greatest(attempt.cast("int") - (WIDER - 1), F.lit(0)))
        return F.array_join(F.transform(F.filter(F.split(F.concat(d, wide), ""), lambda c: c != ""), char), "")

    def card(d: Column, h: Column) -> Column:
        body = let(number(d, h, 0), lambda x: F.concat(F.substr(d, F.lit(1), F.lit(1)), F.substr(x, F.lit(2), F.length(x) - 2)))
        return let(body, lambda b: F.concat(b, ((F.lit(10) - luhn(F.concat(b, F.lit("0")))) % 10).cast("string")))

    def ip(h: Column) -> Column:  # the reserved class, which no host has
        return F.concat_ws(".", (at(h, F.lit(0)) % 16 + 240).cast("string"), *[(at(h, F.lit(3 * i)) % 256).cast("string") for i in (1, 2, 3)])

    def email(x: Column, h: Column) -> Column:
        local, domain = F.substring_index(x, "@", 1), F.substring_index(x, "@", -1)
        top = F.substring_index(domain, ".", -1)
        rest = F.substr(domain, F.lit(1), F.length(domain) - F.length(top) - 1)
        hd = F.sha2(F.concat_ws("|", F.lit(key), F.lit("domain"), domain), 512)
        extra = F.when(attempt > 0, F.concat(F.lit("."), scrambled(F.substr(F.repeat(F.lit("x"), MOST_ATTEMPTS + 2), F.lit(1), attempt.cast("int") + 1), F.reverse(h)))).otherwise(F.lit(""))
        return F.concat(scrambled(local, h), extra, F.lit("@"), scrambled(rest, hd), F.lit("."), top)

    def name(x: Column, h: Column) -> Column:
        def in_script(script: str) -> Column:
            syllables = F.array(*[F.lit(s) for s in SYLLABLES[script].split()])
            body = F.transform(F.sequence(F.lit(1), F.lit(2) + F.when(kind == "last", 1).otherwise(0) + attempt.cast("int")), lambda i: F.get(syllables, (at(h, i * 3) % len(SYLLABLES[script].split())).cast("int")))
            return F.concat(F.array_join(body, ""), F.when(kind == "first_m", F.lit(ENDS[script][0])).when(kind == "first_f", F.lit(ENDS[script][1])).when(kind == "first_n", F.lit(ENDS[script][2])).otherwise(F.lit("")))

        return F.when(x.rlike(r"\p{IsCyrillic}"), in_script("cyrillic")).when(x.rlike(r"\p{IsGreek}"), in_script("greek")).otherwise(in_script("latin"))

    def made(h: Column) -> Column:
        return (
            F.when(kind == "email", email(norm, h))
            .when(kind == "ip", ip(h))
            .when(kind == "card", card(norm, h))
            .when(kind == "phone", number(norm, h, 2))
            .when(kind == "ssn", F.concat(F.lit("9"), F.substr(number(norm, h, 0), F.lit(2), F.lit(8 + MOST_ATTEMPTS))))
            .otherwise(name(norm, h))
        )

    return let(h, made)


def assigned(entities: DataFrame, key: str) -> DataFrame:
    """(kind, norm, surrogate) of distinct entities, one-to-one, and no surrogate an original.

    Rounds: entities without a surrogate try the next one; of those that try the same, the first by norm
    has it, unless it is taken or is an original itself. Names of any kind must differ from all other names.
    A kind has more replacements with each attempt, so that every entity gets one however many there are."""
    group = lambda k: F.when(k.isin(*NAMES), F.lit("name")).otherwise(k)
    entities = written(entities.select("kind", "norm", group(F.col("kind")).alias("g")), "entities")
    pending, done = entities, None
    for attempt in range(MOST_ATTEMPTS):
        tried = written(pending.withColumn("surrogate", surrogate(key, F.col("kind"), F.col("norm"), F.lit(attempt))), "tried")
        first = F.row_number().over(Window.partitionBy("g", "surrogate").orderBy("norm", "kind"))
        won = tried.withColumn("_n", first).where("_n = 1").drop("_n")
        won = won.join(entities.select(F.col("g"), F.col("norm").alias("surrogate")).distinct(), ["g", "surrogate"], "left_anti")
        if done is not None:
            won = won.join(done.select("g", "surrogate"), ["g", "surrogate"], "left_anti")
        won = written(won.select("kind", "norm", "g", "surrogate"), "won")
        pending = written(tried.drop("surrogate").join(won, ["kind", "norm"], "left_anti"), "pending")
        done = won if done is None else done.unionByName(won)
        if pending.isEmpty():
            return done.select("kind", "norm", "surrogate")
    raise RuntimeError(f"entities left without a surrogate after {MOST_ATTEMPTS} attempts")


def named(entities: DataFrame, key: str) -> DataFrame:
    """(kind, norm, surrogate) of distinct entities. A first name after a neutral title is that of a gendered one, where the corpus has it."""
    entities = written(entities, "entities")
    gendered = entities.where(F.col("kind").isin("first_f", "first_m")).groupBy("norm").agg(F.min("kind").alias("as"))
    also = entities.where("kind = 'first_n'").join(gendered, "norm")
    found = written(assigned(entities.join(also.select("kind", "norm"), ["kind", "norm"], "left_anti"), key), "surrogates")
    same = also.select("norm", F.col("as").alias("kind")).join(found, ["kind", "norm"]).select(F.lit("first_n").alias("kind"), "norm", "surrogate")
    return found.unionByName(same)


def rendered(m: Column, known: Column) -> Column:
    """A mention with its replacement, in its own format."""
    def look(kind: Column, norm: Column) -> Column:
        return F.element_at(known, F.concat(kind, F.lit(":"), norm))

    def spaced(new: Column) -> Column:  # digits of the replacement in the places of the mention's, from the right
        def char(c: Column, i: Column) -> Column:
            right = F.length(digits(F.substr(m, i + 1, F.length(m))))
            return F.when(c.rlike("^[0-9]$") & (right <= F.length(new)), F.substr(new, F.length(new) - right + 1, F.lit(1))).otherwise(c)

        further = F.substr(new, F.lit(1), F.greatest(F.length(new) - F.length(digits(m)), F.lit(0)))
        return F.concat(further, F.array_join(F.transform(F.filter(F.split(m, ""), lambda c: c != ""), char), ""))

    def cased(new: Column, old: Column) -> Column:
        return F.when(old == F.upper(old), F.upper(new)).otherwise(F.initcap(new))

    def person() -> Column:
        title = F.regexp_extract(m, f"^{TITLE}", 0)
        new = F.transform(names_of(m), lambda e: look(e["kind"], e["norm"]))
        old = F.split(F.regexp_replace(m, f"^{TITLE}", ""), " ")
        return F.concat(title, F.array_join(F.zip_with(new, old, cased), " "))

    bare = F.coalesce(*[look(F.lit(k), F.lower(m)) for k in NAMES])

    def by_kind(k: Column) -> Column:
        plain = look(k, norm_of(k, m))
        return F.when(k == "person", person()).when(k == "name", cased(bare, m)).when(k.isin("email", "ip"), plain).otherwise(let(plain, spaced))

    return F.coalesce(let(kind_of(m), by_kind), m)


def replaced(text: Column, known: Column) -> Column:
    """The text with every mention replaced; names met after a title are replaced where they stand alone too, in any
    case that begins with a capital."""
    keys = F.transform(F.filter(F.map_keys(known), lambda k: k.rlike("^(?:last|first_.):")), lambda k: F.regexp_replace(k, "^[a-z_]+:", ""))
    longest = F.transform(F.array_sort(F.transform(keys, lambda k: F.struct((-F.length(k)).alias("n"), k.alias("k")))), lambda x: x["k"])
    names = F.concat(F.lit(r"(?<!\p{L})(?=\p{Lu})(?iu:"), F.array_join(longest, "|"), F.lit(r")(?!\p{L})"))
    pattern = let(pattern_of(text), lambda p: F.when(F.size(keys) > 0, F.concat(p, F.lit("|"), names)).otherwise(p))

    def whole(p: Column) -> Column:
        hits, gaps = F.regexp_extract_all(text, p, F.lit(0)), F.split(text, p, -1)
        return let(F.struct(hits.alias("h"), gaps.alias("g")), lambda s: F.concat(F.get(s["g"], F.lit(0)), F.array_join(F.transform(s["h"], lambda m, i: F.concat(rendered(m, known), F.get(s["g"], i + 1))), "")))

    return let(pattern, whole)


def with_surrogates(frame: DataFrame, text: str, key: str) -> DataFrame:
    """The table with its text replaced and a column ``_n`` of how many distinct entities it had.

    Rows without an entity never move. The others meet their replacements by a hash of the text and a
    salt, so that however many copies a text has, they don't meet in one task."""
    found = F.when(F.col(text).rlike(r"[@0-9]|" + TITLE), entities_of(F.col(text)))
    rows = frame.withColumn("_e", found).withColumn("_e", F.coalesce("_e", F.array().cast("array<struct<kind:string,norm:string>>")))
    some = rows.where(F.size("_e") > 0).withColumn("_k", F.sha2(F.col(text).cast("binary"), 256))
    uses = written(some.select("_k", F.explode("_e").alias("e")).select("_k", "e.kind", "e.norm").distinct(), "uses")
    uses = uses.withColumn("_u", F.pmod(F.xxhash64("_k"), F.lit(USE_SALTS)).cast("int"))
    # an entity that a third of all texts have meets them under many salts; of these only such as it occurs under
    names = uses.select("kind", "norm", "_u").distinct().join(named(uses.select("kind", "norm").distinct(), key), ["kind", "norm"])
    maps = uses.join(names, ["kind", "norm", "_u"]).groupBy("_k").agg(F.map_from_entries(F.collect_list(F.struct(F.concat("kind", F.lit(":"), "norm"), "surrogate"))).alias("_m"))
    maps = maps.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64(*[F.col(c).cast("string") for c in frame.columns if c != text], F.lit(3)), F.lit(SALTS)).cast("int")
    changed = some.withColumn("_s", salt).join(maps, ["_k", "_s"]).withColumn("_n", F.size("_e").cast("long")).withColumn(text, replaced(F.col(text), F.col("_m")))
    kept = [*frame.columns, "_n"]
    return rows.where(F.size("_e") == 0).withColumn("_n", F.lit(0).cast("long")).select(*kept).unionByName(changed.select(*kept))


def protect(docs: DataFrame, doc_id: str, text: str, key: str) -> DataFrame:
    """Per row: doc_id, text with surrogates, n_entities (distinct ones). A null text stays null, an empty one empty.

    Repeated rows stay repeated, with the same text. Of entities that tie for a surrogate the first by norm has it, then by kind. An
    empty table gives an empty one."""
    plain = pick(docs, doc_id, text).toDF("doc_id", "text")
    return with_surrogates(plain, "text", key).select("doc_id", "text", F.col("_n").alias("n_entities"))


def replace_in(docs: DataFrame, text: str, key: str) -> DataFrame:
    """The documents with surrogates in their text; all columns stay."""
    table = Carried(docs)
    return table.back(with_surrogates(table.frame, table.at(text), key))
