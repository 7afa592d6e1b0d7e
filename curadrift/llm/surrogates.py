"""Private data replaced by keyed surrogates, in DataFrame expressions only.

Detected entities are reduced to a canonical form (digits of a phone number, lower-case address, the words of a name), so
that one person or number has one surrogate wherever and however it is written. A surrogate is drawn from a keyed hash of
kind and canonical form, keeps length, character classes, check digit, gender and script, and is written back in the
format of the place it stands in. All canonical forms of the corpus are held in one table: a surrogate that another form
has drawn too, or that is itself a form found in the corpus, is drawn again until none is left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from curadrift.llm.common import query, stored, table

#: The key where none is given: that of the session, if it is set there; keep it secret, or anybody can recompute a surrogate.
KEY, KEY_SETTING = "corpus", "spark.curadrift.surrogates.key"
ROUNDS = 30
#: Draws after which a form gets a character more each time: free formats soon, formats of fixed length only if they are nearly full.
LONGER_AFTER, FIXED_AFTER = 3, 12

# Titles by gender, given names by gender, syllables of invented names.
TITLES = {
    "f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "госпожа", "г-жа"],
    "m": ["Mr", "Herr", "Monsieur", "Señor", "господин", "г-н"],
    "x": ["Dr", "Prof", "Professor"],
}
GIVEN = {
    "f": ["Anna", "Maria", "Mary", "Emma", "Julia", "Laura", "Sophie", "Claire", "Carmen", "Ingrid", "Elizabeth", "Sarah", "Анна", "Мария", "Ольга", "Елена"],
    "m": ["John", "James", "Peter", "Thomas", "Michael", "Hans", "Pierre", "Jean", "Carlos", "David", "Robert", "Klaus", "Иван", "Пётр", "Сергей", "Дмитрий"],
}
LATIN = ["ba", "be", "da", "de", "fa", "ga", "ka", "la", "le", "ma", "me", "na", "ne", "pa", "ra", "re", "sa", "se", "ta", "va", "vo", "lo", "mo", "no"]
CYRILLIC = ["ба", "бе", "да", "де", "фа", "га", "ка", "ла", "ле", "ма", "ме", "на", "не", "па", "ра", "ре", "са", "се", "та", "ва", "во", "ло", "мо", "но"]
SMALL_CYRILLIC = "абвгдежзийклмнопрстуфхцчшщъыьэюя"
LOWER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "0123456789"
ENDINGS = {"f": ("lia", "лия"), "m": ("ron", "рон"), "x": ("rin", "рин"), "family": ("nek", "нек")}

#: Words between the parts of a name; they stay.
PARTICLES = ["von", "van", "de", "del", "della", "di", "da", "dos", "du", "der", "den", "dem", "la", "los", "bin", "ibn", "al", "el", "ter", "ten"]
# loops are possessive: they take no stack, however many words follow
_WORD = r"\p{Lu}(?:[\p{L}\p{M}]|['’](?=\p{Lu})(?![sS](?!\p{L})))++"
_PARTICLE = r"(?:(?:von der|von dem|van der|van den|de la|de los|von|van|de|del|della|di|da|dos|du|bin|ibn|al|el|ter|ten) |(?:al|el)-|d['’]|\p{Lu}\. )"
_NEXT = rf"[- ]{_PARTICLE}*+{_WORD}"
_TITLE = "|".join(sorted((t for ts in TITLES.values() for t in ts), key=len, reverse=True))
_GIVEN = "|".join(n for ns in GIVEN.values() for n in ns)
#: Country codes of one and two digits; all others have three.
_COUNTRY = r"1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3}"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
PATTERNS = {
    "email": r"(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9][A-Za-z0-9-]{0,62}(?:\.[A-Za-z0-9-]{1,63}){0,5}\.[A-Za-z]{2,24}",
    "secret": r"(?i:(?<![A-Za-z])(?:password|passwd|pwd|secret|token|api[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?)[^\s\"'<>;,]{6,}",
    "bearer": r"(?<![A-Za-z])(?i:bearer)[ \t]{1,3}[A-Za-z0-9._~+/-]{16,}+={0,2}",
    "ipv6": r"(?<![\w:.])(?=[A-Fa-f:]*[0-9])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\w:])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?=(?: ?[A-Z]{0,4}\d){8})(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "key": r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])",
    "ip": rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)|(?<![\w+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\d)",
    "card": r"(?<!\d)\d(?:[ -]?\d){12,18}(?!\d)",
    "name": rf"(?<![\p{{L}}\p{{N}}])(?:(?:(?:{_TITLE})\.? )++{_PARTICLE}*+{_WORD}(?:{_NEXT})*+|(?:{_GIVEN})(?:{_NEXT})++)",
}
#: A capitalised word, which may be a later mention of a name.
MENTION = rf"(?<![\p{{L}}\p{{N}}]){_WORD}"
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Every entity but a name holds one of these: a cheap look before the patterns.
SIGNS = "[0-9@=:]"


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def has_entity(text: Column) -> Column:
    """Whether any pattern occurs; false for null."""
    return F.coalesce((text.rlike(SIGNS) | text.rlike(PATTERNS["name"])) & text.rlike(ANY), F.lit(False))


def kind_of(surface: Column) -> Column:
    """The first kind whose pattern fits the whole entity."""
    out = F.lit("card")
    for kind, pattern in reversed(PATTERNS.items()):
        out = F.when(surface.rlike(f"^(?:{pattern})$"), F.lit(kind)).otherwise(out)
    return out


def atoms(surface: Column, kind: Column) -> Column:
    """An entity as parts in order: ``kind`` null for a part that stays (a title, a particle, the word before a secret).

    A given name has its own gender, an unknown one after a title the title's; all other words of a name are family names.
    """
    def part(k, p):
        return F.struct(k.cast("string").alias("kind"), p.alias("part"))

    none = F.lit(None).cast("string")
    secret = F.regexp_extract(surface, r"^([A-Za-z_-]+\s*[=:]\s*[\"']?)(.*)$", 1)
    titles = F.regexp_extract(surface, rf"^(?:(?:{_TITLE})\.? )++", 0)
    title_gender = F.lit("x")
    for gender in ("m", "f"):
        title_gender = F.when(titles.rlike(rf"(?<!\p{{L}})(?:{'|'.join(TITLES[gender])})\.? "), gender).otherwise(title_gender)
    rest = F.substr(surface, F.length(titles) + 1, F.length(surface))
    # words with what stands before them; a lambda would split again for every word
    words = F.zip_with(F.split(rest, _WORD, -1), F.regexp_extract_all(rest, F.lit(_WORD), F.lit(0)), lambda gap, w: F.struct(gap.alias("gap"), w.alias("word")))
    several = rest.rlike(rf"{_WORD}.*?{_WORD}")

    def word_kind(word, i):
        low = F.lower(word)
        return (
            F.when(low.isin(*map(str.lower, GIVEN["f"])), "given_f").when(low.isin(*map(str.lower, GIVEN["m"])), "given_m")
            .when(word.isNull() | low.isin(*PARTICLES), none).when((i == 0) & several, F.concat(F.lit("given_"), title_gender)).otherwise("family")
        )

    named = F.concat(F.array(part(none, titles)), F.flatten(F.transform(words, lambda w, i: F.array(
        part(none, w["gap"]), part(word_kind(w["word"], i), F.coalesce(w["word"], F.lit("")))))))
    bearer = r"^([A-Za-z]+\s+)(.*)$"
    return (
        F.when(kind == "secret", F.array(part(none, secret), part(kind, F.regexp_extract(surface, r"^([A-Za-z_-]+\s*[=:]\s*[\"']?)(.*)$", 2))))
        .when(kind == "bearer", F.array(part(none, F.regexp_extract(surface, bearer, 1)), part(F.lit("secret"), F.regexp_extract(surface, bearer, 2))))
        .when(kind == "name", named).otherwise(F.array(part(kind, surface)))
    )


def _is_name(kind: Column) -> Column:
    return kind.startswith("given") | (kind == "family")


def one_kind(kind: Column) -> Column:
    """The kind of a word of a name that was found as several: a given name rather than a family name, with its gender if there is one."""
    f, m, x = (F.bool_or(kind == f"given_{g}") for g in "fmx")
    return F.when(f & ~m, "given_f").when(m & ~f, "given_m").when(f | m | x, "given_x").otherwise(F.first(kind))


def _phone(part: Column) -> Column:
    """The number's own digits; then, for a number abroad, a plus sign and its country code."""
    code = F.regexp_extract(part, rf"^\+({_COUNTRY})", 1)
    return F.when((code == "") | code.isin("1"), F.substring(_digits(part), -10, 10)).otherwise(
        F.concat(F.substr(_digits(part), F.length(code) + 1, F.length(part)), F.lit("+"), code))


def canonical(kind: Column, part: Column) -> Column:
    """What all spellings of one entity share."""
    return (
        F.when(kind == "phone", _phone(part))
        .when(kind.isin("card", "ssn"), _digits(part)).when(kind == "iban", F.replace(part, F.lit(" "))).when(kind == "ipv6", F.lower(part))
        .when(_is_name(kind), F.translate(F.lower(part), "’", "'")).when(kind == "email", F.lower(part))
        .otherwise(part)
    )


def _stream(seed: Column, length: Column) -> Column:
    """Hex digits enough for two a character."""
    blocks = F.sequence(F.lit(0), F.floor(length / F.lit(32)).cast("int"))
    return F.concat_ws("", F.transform(blocks, lambda b: F.sha2(F.concat(seed, F.lit("#"), b.cast("string")), 256)))


def _byte(stream: Column, i: Column) -> Column:
    return F.conv(F.substr(stream, i * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _pick(letters: str, n: Column) -> Column:
    return F.substr(F.lit(letters), F.pmod(n, F.lit(len(letters))) + 1, F.lit(1))


def _redrawn(text: Column, seed: Column) -> Column:
    """Each digit and letter replaced by one of its class."""
    stream = _stream(seed, F.length(text))

    def one(ch, i):
        n = _byte(stream, i)
        return (
            F.when(ch.rlike("[0-9]"), _pick(DIGITS, n)).when(ch.rlike("[a-z]"), _pick(LOWER, n)).when(ch.rlike("[A-Z]"), _pick(LOWER.upper(), n)).otherwise(ch)
        )

    return F.concat_ws("", F.transform(F.split(text, ""), one))


def _secret(text: Column, seed: Column) -> Column:
    """Each character replaced by one of its class: hex strings stay hex strings, Cyrillic letters Cyrillic, other letters become
    Latin. ASCII signs stay, unless there is nothing else; what has no class becomes a small letter or a digit."""
    stream = _stream(seed, F.length(text))
    hexed, signs = text.rlike("^[0-9a-f]{8,}$"), text.rlike(r"^\p{Punct}*$")

    def one(ch, i):
        n = _byte(stream, i)
        return (
            F.when(hexed, _pick("0123456789abcdef", n)).when(signs, _pick(LOWER + DIGITS, n)).when(ch.rlike(r"\p{Nd}"), _pick(DIGITS, n))
            .when(ch.rlike(r"[\p{IsCyrillic}&&\p{Lu}]"), _pick(SMALL_CYRILLIC.upper(), n))
            .when(ch.rlike(r"[\p{IsCyrillic}&&\p{L}]"), _pick(SMALL_CYRILLIC, n))
            .when(ch.rlike(r"\p{Lu}"), _pick(LOWER.upper(), n)).when(ch.rlike(r"\p{L}"), _pick(LOWER, n))
            .when(ch.rlike(r"\p{Punct}"), ch).otherwise(_pick(LOWER + DIGITS, n))
        )

    return F.concat_ws("", F.transform(F.split(text, ""), one))


def _longer(text: Column, attempt: Column, after: int, fill: str) -> Column:
    """A form with a character more for each draw beyond ``after``."""
    return F.concat(text, F.repeat(F.lit(fill), F.greatest(attempt - after, F.lit(0)).cast("int")))


def _luhn_sum(digits: Column) -> Column:
    """Sum of the check-digit rule, the last digit not doubled."""
    back = F.split(F.reverse(digits), "")
    terms = F.transform(back, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
        F.floor(d.cast("int") * 2 / F.lit(10)).cast("int") + F.pmod(d.cast("int") * 2, F.lit(10))))
    return F.aggregate(terms, F.lit(0), lambda a, t: a + t)


def _iban_check(country: Column, account: Column) -> Column:
    """The two digits that make an account number 1 modulo 97, its letters counted from 10."""
    spelled = F.transform(F.split(F.concat(account, country, F.lit("00")), ""), lambda c: F.when(c.rlike("[0-9]"), c).otherwise((F.ascii(c) - 55).cast("string")))
    rest = F.aggregate(F.split(F.concat_ws("", spelled), ""), F.lit(0), lambda a, d: F.pmod(a * 10 + F.coalesce(d.try_cast("int"), F.lit(0)), F.lit(97)))
    return F.lpad((F.lit(98) - rest).cast("string"), 2, "0")


def _name(seed: Column, canon: Column, ending: tuple[str, str], length: Column) -> Column:
    stream = _stream(seed, F.lit(40))

    def spelled(syllables, last):
        held = F.array(*[F.lit(s) for s in syllables])
        return F.initcap(F.concat(
            F.concat_ws("", F.transform(F.sequence(F.lit(0), length), lambda i: F.element_at(held, F.pmod(_byte(stream, i), F.lit(len(syllables))) + 1))),
            F.lit(last)))

    return F.when(canon.rlike(r"\p{IsCyrillic}"), spelled(CYRILLIC, ending[1])).otherwise(spelled(LATIN, ending[0]))


def surrogate(kind: Column, canon: Column, attempt: Column, key: str) -> Column:
    """The draw number ``attempt`` for a canonical form. Late draws are longer than the form, so that a free one always exists."""
    seed = F.concat_ws("|", F.lit(key), kind, canon, attempt.cast("string"))
    domain = F.regexp_extract(canon, "@(.*)$", 1)
    labels = F.regexp_extract(domain, r"^(.*)\.[^.]*$", 1)
    number = _longer(canon, attempt, FIXED_AFTER, "0")
    drawn = _redrawn(number, seed)
    rest = F.substr(drawn, F.lit(2), F.length(drawn))
    card = F.concat(F.substring(canon, 1, 1), F.substr(drawn, F.lit(2), F.length(drawn) - 2), F.lit("0"))
    checked = F.concat(F.substr(card, F.lit(1), F.length(card) - 1), F.pmod(-_luhn_sum(card), F.lit(10)).cast("string"))
    stream = _stream(seed, F.lit(8))
    # more syllables with every draw: the space grows until all forms find a place
    size = F.lit(2) + F.floor(attempt / F.lit(4)).cast("int")
    out = _secret(_longer(canon, attempt, LONGER_AFTER, "a"), seed)
    out = F.when(kind == "email", F.concat(
        _redrawn(_longer(F.regexp_extract(canon, "^([^@]*)@", 1), attempt, LONGER_AFTER, "a"), seed), F.lit("@"),
        _redrawn(labels, F.concat_ws("|", F.lit(key), F.lit("domain"), domain)), F.lit(".example"))).otherwise(out)
    own, abroad = F.regexp_extract(canon, "^[0-9]*", 0), F.regexp_extract(canon, r"\+.*$", 0)
    own = _redrawn(_longer(own, attempt, FIXED_AFTER, "0"), seed)
    out = F.when(kind == "phone", F.concat(_pick("23456789", _byte(stream, F.lit(0))), F.substr(own, F.lit(2), F.length(own)), abroad)).otherwise(out)
    out = F.when(kind == "ssn", F.concat(F.lit("9"), rest)).otherwise(out)
    out = F.when(kind == "card", F.when(F.pmod(_luhn_sum(canon), F.lit(10)) == 0, checked).otherwise(F.concat(F.substring(canon, 1, 1), rest))).otherwise(out)
    # all four numbers; from the documentation range of the longer addresses where those are used up
    short = F.concat_ws(".", *[(F.pmod(_byte(stream, F.lit(i)), F.lit(254)) + 1).cast("string") for i in range(4)])
    long = F.concat(F.lit("2001:db8"), *[F.concat(F.lit(":"), F.substr(stream, F.lit(4 * i + 1), F.lit(4))) for i in range(6)])
    out = F.when(kind == "ip", F.when(attempt > FIXED_AFTER, long).otherwise(short)).otherwise(out)
    # after the prefix of the documentation range: the groups and their zeros as they stand
    out = F.when(kind == "ipv6", F.concat(F.lit("2001:db8:"), F.substr(long, F.lit(10), F.length(long)))).otherwise(out)
    # the country stays, all else is drawn, and the check digits follow
    account = _redrawn(F.substr(number, F.lit(5), F.length(number)), seed)
    out = F.when(kind == "iban", F.concat(F.substring(canon, 1, 2), _iban_check(F.substring(canon, 1, 2), account), account)).otherwise(out)
    out = F.when(kind == "key", F.concat(F.lit("AKIA"), F.substr(drawn, F.lit(5), F.length(drawn)))).otherwise(out)
    for name, ending in ENDINGS.items():
        is_kind = kind == (name if name == "family" else f"given_{name}")
        out = F.when(is_kind, _name(seed, canon, ending, size)).otherwise(out)
    return out


def written(kind: Column, part: Column, drawn: Column) -> Column:
    """A surrogate in the format of the place: grouped digits from the right, those beyond the form's length at the end, upper case
    where the entity is upper case."""
    chars = F.split(part, "")
    held = F.length(F.regexp_replace(canonical(kind, part), r"\+.*$", ""))
    drawn = F.when(kind == "phone", F.regexp_replace(drawn, r"\+.*$", "")).otherwise(drawn)

    def digit(ch, i):
        after = F.length(_digits(F.substr(part, i + 2, F.length(part))))
        return F.when(ch.rlike("[0-9]") & (after < held), F.substr(drawn, held - after, F.lit(1))).otherwise(ch)

    return (
        F.when(kind.isNull(), part)
        .when(kind.isin("phone", "card", "ssn"), F.concat(F.concat_ws("", F.transform(chars, digit)), F.substr(drawn, held + 1, F.length(drawn))))
        .when(kind.isin("ip", "ipv6", "key", "secret"), drawn)
        .when(kind == "iban", F.when(part.contains(" "), F.trim(F.regexp_replace(drawn, "(.{4})", "$1 "))).otherwise(drawn))
        .when((part == F.upper(part)) & (F.length(part) > 1), F.upper(drawn))
        .otherwise(drawn)
    )


def distinct_surrogates(forms: DataFrame, key: str = KEY, rounds: int = ROUNDS) -> DataFrame:
    """``kind``, ``canon``, ``drawn``: a surrogate of its own for each form, none of them a form itself, by drawing again."""
    held = stored(forms.select("kind", "canon", F.lit(0).alias("attempt"), surrogate(F.col("kind"), F.col("canon"), F.lit(0), key).alias("drawn")),
                  "surrogates-0")
    taken = forms.select("kind", F.lower("canon").alias("low")).withColumn("real", F.lit(True))
    for turn in range(1, rounds + 1):
        low = F.lower("drawn")
        firsts = held.groupBy("kind", low.alias("low")).agg(F.min(F.struct("attempt", "canon")).alias("first"), F.count("*").alias("met"))
        bad = firsts.join(taken.distinct(), ["kind", "low"], "left").where("met > 1 OR real").select("kind", "low", "first", "real")
        if not bad.limit(1).count():
            return held.select("kind", "canon", "drawn")
        marked = held.withColumn("low", low).join(bad, ["kind", "low"], "left")
        again = F.col("first").isNotNull() & (F.col("real") | (F.col("first.canon") != F.col("canon")))
        held = stored(
            marked.withColumn("attempt", F.when(F.coalesce(again, F.lit(False)), F.lit(turn)).otherwise(F.col("attempt")))
            .withColumn("drawn", F.when(F.col("attempt") == turn, surrogate(F.col("kind"), F.col("canon"), F.col("attempt"), key)).otherwise(F.col("drawn")))
            .select("kind", "canon", "attempt", "drawn"), f"surrogates-{turn}")
    raise RuntimeError("surrogates did not become distinct")


def replacements(docs: DataFrame, key: str = KEY) -> DataFrame:
    """Per distinct text with entities: ``text_id``; ``drawn``, the surrogates in text order, and ``kinds`` as they were found; ``after``, null
    for a text without names, else per gap between entities its capitalised words with surrogates (``out``) for those that are
    part of a name of the text and null for the others."""
    text = docs.where(has_entity(F.col("text"))).select(F.md5("text").alias("text_id"), "text")
    found = text.select("text_id", F.regexp_extract_all("text", F.lit(ANY), F.lit(0)).alias("found"), F.when(
        F.col("text").rlike(PATTERNS["name"]), F.transform(F.split("text", ANY, -1), lambda gap: F.regexp_extract_all(gap, F.lit(MENTION), F.lit(0)))).alias("words"))
    found = stored(found.dropDuplicates(["text_id"]), "surrogates-found")
    entities = found.select("text_id", F.posexplode("found").alias("pos", "surface")).withColumn("entity", kind_of(F.col("surface")))
    parts = entities.select("text_id", "pos", "entity", F.posexplode(atoms(F.col("surface"), F.col("entity"))).alias("sub", "atom")).select(
        "text_id", "pos", "entity", "sub", F.col("atom.kind").alias("kind"), F.col("atom.part").alias("part"))
    # one word of a name is one form, whatever it was found as
    group = F.when(_is_name(F.col("kind")), "name").otherwise(F.col("kind"))
    parts = stored(parts.withColumn("canon", canonical(F.col("kind"), F.col("part"))).withColumn("group", group), "surrogates-parts")
    forms = parts.where("kind is not null").groupBy("group", "canon").agg(one_kind(F.col("kind")).alias("kind"))
    drawn = distinct_surrogates(forms.select("kind", "canon"), key).select(
        F.when(_is_name(F.col("kind")), "name").otherwise(F.col("kind")).alias("group"), "canon", "drawn")
    filled = stored(parts.join(drawn, ["group", "canon"], "left"), "surrogates-filled")
    outs = filled.withColumn("out", written(F.col("kind"), F.col("part"), F.col("drawn")))
    whole = outs.groupBy("text_id", "pos").agg(
        F.concat_ws("", F.transform(F.sort_array(F.collect_list(F.struct("sub", "out"))), lambda s: s["out"])).alias("out"), F.first("entity").alias("entity"))
    ordered = whole.groupBy("text_id").agg(F.sort_array(F.collect_list(F.struct("pos", "out", "entity"))).alias("all"))
    # later mentions: every capitalised word of a text with names, joined with the names' words
    words = found.where("words is not null").select("text_id", F.posexplode("words").alias("gap", "words")).select(
        "text_id", "gap", F.posexplode_outer("words").alias("nth", "part")).withColumn("canon", canonical(F.lit("family"), F.col("part")))
    names = filled.where("group = 'name'").select("text_id", "canon", "drawn").distinct()
    said = words.join(names, ["text_id", "canon"], "left").withColumn(
        "out", F.when(F.col("drawn").isNotNull(), written(F.lit("family"), F.col("part"), F.col("drawn"))))
    gaps = said.groupBy("text_id", "gap").agg(F.sort_array(F.collect_list(F.struct("nth", "part", "out"))).alias("words"))
    after = gaps.groupBy("text_id").agg(F.sort_array(F.collect_list(F.struct("gap", "words"))).alias("after"))
    return ordered.join(after, "text_id", "left").select("text_id", F.col("all.out").alias("drawn"), F.col("all.entity").alias("kinds"), F.col("after.words").alias("after"))


def _rewritten(docs: DataFrame, key: str | None) -> tuple[DataFrame, list[Column]]:
    """Rows as ``row``, ``text``, ``entities``; and the columns of ``docs`` from them."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text"))
    has = has_entity(F.col("text"))
    key = key or docs.sparkSession.conf.get(KEY_SETTING, KEY)
    found = replacements(docs.select("text").where(F.col("text").isNotNull()), key)
    hit = packed.where(has).withColumn("text_id", F.md5("text")).join(found, "text_id")
    between, nothing = F.split("text", ANY, -1), F.lit("")

    def mended(piece, i):
        """A gap with later mentions of names replaced."""
        said = F.get("after", i)
        return F.when(said.isNull(), piece).otherwise(F.concat_ws("", F.transform(F.split(piece, MENTION, -1), lambda rest, n: F.concat(
            rest, F.coalesce(F.get(said, n)["out"], F.get(said, n)["part"], nothing)))))

    def kinds(i):
        again = F.transform(F.filter(F.get("after", i), lambda w: w["out"].isNotNull()), lambda w: F.lit("name"))
        return F.concat(F.coalesce(again, F.array().cast("array<string>")), F.filter(F.array(F.get("kinds", i)), lambda k: k.isNotNull()))

    plain = F.col("after").isNull()
    rewritten = F.concat_ws("", F.transform(between, lambda piece, i: F.concat(
        F.when(plain, piece).otherwise(mended(piece, i)), F.coalesce(F.get("drawn", i), nothing))))
    entities = F.when(plain, F.col("kinds")).otherwise(F.flatten(F.transform(F.sequence(F.lit(0), F.size("kinds")), kinds)))
    both = hit.select("row", rewritten.alias("text"), entities.alias("entities")).unionByName(
        packed.where(~has).select("row", "text", F.array().cast("array<string>").alias("entities")))
    own = [
        F.col("text").alias(c) if c == "text"
        else F.when(F.size("entities") == 0, F.col("row.n_chars")).otherwise(F.length("text")).cast(docs.schema[c].dataType).alias(c)
        if c == "n_chars" else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    return both, own


def with_surrogates(docs: DataFrame, key: str | None = None) -> DataFrame:
    """``docs`` (all columns, ``text`` rewritten, ``n_chars`` following it where it is a column) and ``entities_found``: their kinds, in
    text order.

    Rows without entities pass through without a shuffle. Null and empty texts have no entities; equal texts get equal
    results, repeated rows and null ids stay as they are.
    """
    both, own = _rewritten(docs, key)
    return both.select(*own, F.col("entities").alias("entities_found"))


def without_private_data(docs: DataFrame, key: str | None = None) -> DataFrame:
    """``docs`` with surrogates in ``text`` and no other column added."""
    both, own = _rewritten(docs, key)
    return both.select(*own)


@query("op10_surrogates")
def op10_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = with_surrogates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "text", F.size("entities_found").cast("long").alias("n_entities"), F.array_join("entities_found", ",").alias("kinds"))
