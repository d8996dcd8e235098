"""PII: detected entities get surrogates.

Entities are found by one pattern: e-mail addresses, secrets that follow a name and ``=`` or
``:``, access keys, IBANs, social security, phone and card numbers, IPv4 and IPv6 addresses,
and names after a title; of such a name also its other mentions in the document, part by part. A surrogate is made from a keyed SHA-256 stream over (kind, canonical
form, attempt), so it is the same wherever the entity occurs and can't be turned back
without the key. It keeps kind and format: digits stay digits, letters keep their case,
hexadecimal stays so, punctuation and grouping stay; a phone keeps its country code, a card
its first digit and its length and a valid check digit, an address stays an address; a name is spelled in
the script of the original (in Latin where ``SYLLABLES`` doesn't have it), with an ending for
the title's gender. The canonical form drops
grouping and case, so other spellings of a number share one surrogate (coreference).

Collision checks: surrogates of distinct entities must differ, and none may equal an entity
of the corpus. Losers (all but the first by canonical form) try again with the next attempt,
until there are none; one round a shuffle of the distinct entities, then of the losers.
The space grows with the attempt (names get more syllables, others more characters after
``SAME_FORM`` or ``SAME_DIGITS`` attempts), so the rounds end however many entities there are.
An e-mail's domain is an entity of its own and draws by itself, once for all its addresses; so
is each part of a name (a first name by the title's gender, others without), and what is
checked are the parts: a surname has one surrogate wherever it occurs.

All is DataFrame functions. Entities are made distinct (combined before the shuffle), so a
hot one is one row; only documents that hold an entity are shuffled to be put together again.

Defined cases: null text stays null; a text without entities is returned as it is; rows of
equal doc_id and text are treated alike, each row stays; matches don't overlap, the leftmost
is taken and at one place the first kind of the list; a name's part of one letter is replaced
only behind its title; n_entities counts matches of the pattern, not the bare mentions of a
name. Other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mercato.llm.common import free_names, freeze, read_table

#: Demonstration key; give your own and keep it secret.
KEY = "surrogate-key"

FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Signora", "Г-жа", "Κυρία")
MALE = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Signor", "Г-н", "Κύριος")
NEUTRAL = ("Dr", "Prof")
_TITLES = "|".join((*FEMALE, *MALE, *NEUTRAL))
#: a possessive 's is no part of it
_NAME = r"\p{Lu}[\p{L}\p{M}]*+(?:['’-](?!s(?![\p{L}\p{M}]))[\p{L}\p{M}]++)*+"
_SECRET = r"(?i:password|passwd|token|secret|api[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?"

#: between two digits of a phone number with its country code; no card begins behind it
_GAP = r"(?: ?\((?:0\))?|\)? (?!(?:[0-9]{4}[ -]?){3}[0-9])|\)|[./-])?"
_HEX = "[0-9A-Fa-f]{1,4}"
#: fixed values: characters of an account number by country, where they aren't a multiple of four; others have 16 to 32
IBAN_LENGTHS = {22: "DE GB IE BG BH ME RS GE", 27: "FR IT MC SM GR", 18: "NL DK FI FO GL", 21: "CH LI HR LV", 25: "PT", 23: "AE GI IL", 19: "MK SI", 26: "IS TR", 29: "BR EG PS QA", 31: "MT", 15: "NO"}


def _iban(countries: str, length: int) -> str:
    """The two letters, two check digits, groups of four and what is left."""
    groups, rest = divmod(length - 4, 4)
    return rf"(?:{countries.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{groups}}} ?[A-Z0-9]{{{rest}}}"


_IBANS = "|".join([*(_iban(countries, length) for length, countries in IBAN_LENGTHS.items()),
                   rf"(?!{'|'.join(IBAN_LENGTHS.values()).replace(' ', '|')})[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{3,7}}"])
#: kind -> pattern; the order decides
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "secret": rf"\b{_SECRET}(?=[_+/-]*[A-Za-z0-9])[A-Za-z0-9_+/-]{{8,}}",
    "access_key": r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b",
    "iban": rf"\b(?:{_IBANS})\b",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9+-])(?:[0-9]{4}([ -]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}|3[47][0-9]{2}([ -]?)[0-9]{6}\2[0-9]{5})(?![0-9-])",
    "phone": r"(?<![0-9])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])"
             rf"|(?<![0-9+])(?:\+[1-9]|00[1-9][0-9]{{0,2}}[ .-])(?:{_GAP}[0-9]){{7,14}}(?![0-9])"
             r"|(?<![0-9.+-])(?:0[1-9](?:[ .][0-9]{2}){4}|[6-9][0-9]{2}(?: [0-9]{2}){3})(?![0-9]|[.-][0-9])",
    "ipv6": rf"(?<![0-9A-Za-z:.])(?:(?:{_HEX}:){{7}}{_HEX}|(?=[0-9A-Fa-f:]*[0-9]){_HEX}(?::{_HEX}){{0,5}}::(?:{_HEX}(?::{_HEX}){{0,5}})?)(?![0-9A-Za-z:])",
    "ip": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])",
    "name": rf"\b(?:{_TITLES})\.? {_NAME}(?: {_NAME})?",
}
PATTERN = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: no entity without one of these
HINT = rf"[0-9@]|(?:{_TITLES})\.? \p{{Lu}}|[=:]|AKIA|ASIA"
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
GROUPED = ("card", "phone", "ssn", "iban")
#: attempts in the entity's own form; numbers of a fixed length keep it longer
SAME_FORM, SAME_DIGITS = 4, 16
#: calling codes of one and two digits; all others have three
COUNTRY = r"^\+(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
#: consonants, vowels and endings of names, by script; the first is that of all other scripts
SYLLABLES = {
    "Latin": ("bdfgklmnprstv", "aeiou", "a", "n"),
    "Cyrillic": ("бвдгклмнпрст", "аеиоу", "а", "н"),
    "Greek": ("βγδκλμνπρστφ", "αεηιο", "α", "ς"),
    "Armenian": ("բգդզլխկմնպստ", "աեիոէ", "ա", "ն"),
}


def kind_of(entity: Column) -> Column:
    """The first kind whose pattern is the entity as a whole."""
    out = F.lit("name")
    for kind, pattern in reversed(list(PATTERNS.items())[:-1]):
        out = F.when(F.regexp_like(entity, F.lit(f"^(?:{pattern})$")), kind).otherwise(out)
    return out


def value_of(kind: Column, entity: Column) -> Column:
    """What is replaced: of a secret only what follows the sign."""
    return F.when(kind == "secret", F.regexp_replace(entity, f"^{_SECRET}", "")).otherwise(entity)


def _groups(address: Column) -> tuple[Column, Column]:
    """The groups of an IPv6 address before and behind its double colon."""
    of = lambda text: F.filter(F.split(text, ":"), lambda g: g != "")
    before = F.regexp_extract(address, "^(.*?)(?:::|$)", 1)
    return of(before), of(F.substring(address, F.length(before) + 1, F.length(address)))


def canonical(kind: Column, value: Column) -> Column:
    """A phone keeps the sign of its country code, an IPv6 address gets all its eight groups."""
    plain = F.regexp_replace(value, "[^0-9A-Za-z]", "")
    before, behind = _groups(F.lower(value))
    zeros = F.array_repeat(F.lit("0"), F.greatest(F.lit(0), 8 - F.size(before) - F.size(behind)))
    full = F.array_join(F.transform(F.concat(before, zeros, behind), lambda g: F.lpad(g, 4, "0")), ":")
    return (F.when((kind == "phone") & F.regexp_like(value, F.lit(r"^(?:\+|00[1-9])")), F.concat(F.lit("+"), F.regexp_replace(plain, "^00", "")))
            .when(kind == "ipv6", full).when(kind.isin(*GROUPED), plain)
            .when(kind == "email", F.lower(value)).otherwise(value))


def _stream(kind: Column, canon: Column, attempt: Column, key: str) -> Column:
    """Hex digits, 64 for every 16 characters of the entity and 64 more, and 64 for every 4 attempts."""
    last = (F.floor(F.length(canon) / 16) + F.floor(attempt / 4)).cast("int")
    return F.array_join(F.transform(F.sequence(F.lit(0), last), lambda b: F.sha2(
        F.concat_ws("|", F.lit(key), kind, canon, attempt.cast("string"), b.cast("string")).cast("binary"), 256)), "")


def _number(stream: Column, i: Column, n: Column | int) -> Column:
    """The i-th number below n of the stream (two bytes each)."""
    four = F.substring(stream, (i * 4 + 1).cast("int"), F.lit(4))
    return (F.conv(four, 16, 10).cast("int") % n).cast("int")


def _pick(letters: str, number: Column) -> Column:
    return F.substring(F.lit(letters), number + 1, F.lit(1))


def _chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _same_shape(text: Column, stream: Column) -> Column:
    """Each digit, lower and upper letter by another of its class; hexadecimal by such."""
    hexadecimal = F.regexp_like(text, F.lit("^(?=.*[a-f])(?=.*[0-9])[0-9a-f]+$"))
    return F.array_join(F.transform(_chars(text), lambda c, i: (
        F.when(hexadecimal, _pick("0123456789abcdef", _number(stream, i, 16)))
        .when(c.between("0", "9"), _pick(DIGITS, _number(stream, i, 10)))
        .when(c.between("a", "z"), _pick(LOWER, _number(stream, i, 26)))
        .when(c.between("A", "Z"), _pick(UPPER, _number(stream, i, 26)))
        .otherwise(c))), "")


def _more(canon: Column, stream: Column, attempt: Column, form: int, letters: str) -> Column:
    """Characters behind a surrogate: none for the first ``form`` attempts, then one more each time as many."""
    many = F.floor(attempt / form).cast("int")
    return F.when(many == 0, "").otherwise(F.array_join(F.transform(
        F.sequence(F.lit(1), many), lambda i: _pick(letters, _number(stream, F.length(canon) + i - 1, len(letters)))), ""))


def _phone(canon: Column, stream: Column) -> Column:
    """The country code kept; the number, and the exchange of ten digits, begin with 2 to 9."""
    code = F.when(canon.startswith("+"), F.concat(F.lit("+"), F.regexp_extract(canon, COUNTRY, 1))).otherwise(F.lit(""))
    many = F.length(canon) - F.length(code)
    return F.concat(code, F.array_join(F.transform(
        F.sequence(F.lit(0), many - 1), lambda i: F.when((i == 0) | ((i == 3) & (many == 10)), _pick(DIGITS[2:], _number(stream, i, 8)))
        .otherwise(_pick(DIGITS, _number(stream, i, 10)))), ""))


def _card(canon: Column, stream: Column) -> Column:
    """The first digit kept (two of 15 digits), the last one the Luhn check digit."""
    kept = F.when(F.length(canon) == 15, 2).otherwise(1)
    body = F.concat(F.substring(canon, F.lit(1), kept), F.array_join(F.transform(
        F.sequence(kept, F.length(canon) - 2), lambda i: _pick(DIGITS, _number(stream, i, 10))), ""))
    total = F.aggregate(F.transform(_chars(body), lambda c, i: F.when(
        (F.length(body) - i) % 2 == 1, F.floor(c.cast("int") * 2 / 10) + c.cast("int") * 2 % 10).otherwise(c.cast("int")).cast("long")),
        F.lit(0).cast("long"), lambda a, b: a + b)
    return F.concat(body, ((10 - total % 10) % 10).cast("string"))


def _ipv6(canon: Column, stream: Column) -> Column:
    """Each group that isn't zero by another such."""
    return F.array_join(F.transform(F.split(canon, ":"), lambda g, i: F.when(g == "0000", g).otherwise(
        F.lpad(F.lower(F.hex(1 + _number(stream, i, 65535))), 4, "0"))), ":")


def _token(kind: Column, canon: Column) -> Column:
    """What stands in the text for a canonical form."""
    return F.when(kind == "part", F.regexp_replace(canon, "^[fm]?:", "")).otherwise(canon)


def _spelled(token: Column, stream: Column, attempt: Column, female: Column, male: Column) -> Column:
    """A name of three syllables, one more for every two attempts, and an ending by gender, if any."""
    out = None
    last = (2 + F.floor(attempt / 2)).cast("int")
    for script, (consonants, vowels, a, n) in SYLLABLES.items():
        letters = F.array_join(F.transform(F.sequence(F.lit(0), last), lambda s: F.concat(  # noqa: B023
            _pick(consonants, _number(stream, 2 * s, len(consonants))), _pick(vowels, _number(stream, 2 * s + 1, len(vowels))))), "")  # noqa: B023
        ending = F.when(female, F.lit(a)).when(male, F.lit(n)).otherwise(F.lit(""))
        spelled = F.concat(F.upper(F.substring(letters, 1, 1)), F.substring(letters, F.lit(2), F.length(letters)), ending)
        out = spelled if out is None else F.when(F.regexp_like(token, F.lit(rf"^\p{{Is{script}}}")), spelled).otherwise(out)
    return out


def _parts(name: Column) -> Column:
    """The parts of a name behind its title as (gender of a first name):(token)."""
    tokens = F.split(name, " ")
    title = F.regexp_replace(tokens[0], r"\.$", "")
    gender = F.when(title.isin(*FEMALE), "f").when(title.isin(*MALE), "m").otherwise("")
    rest = F.slice(tokens, F.lit(2), F.size(tokens) - 1)
    return F.transform(rest, lambda t, i: F.concat_ws(":", F.when((i == 0) & (F.size(rest) > 1), gender).otherwise(""), t))


def surrogate(kind: Column, canon: Column, attempt: Column, key: str = KEY) -> Column:
    """The replacement of a canonical form; of an e-mail address only of what is before the domain."""
    stream = _stream(kind, canon, attempt, key)
    digits = _more(canon, stream, attempt, SAME_DIGITS, DIGITS)
    letters = _more(canon, stream, attempt, SAME_FORM, LOWER)
    octets = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (1 + _number(stream, i, 254)).cast("string")), ".")
    top, local = F.substring_index(canon, ".", -1), F.substring_index(canon, "@", 1)
    body = F.substring(canon, F.lit(1), F.length(canon) - F.length(top) - 1)
    return (F.when(kind == "email", F.concat(_same_shape(local, stream), letters, F.lit("@"), F.substring_index(canon, "@", -1)))
            .when(kind == "domain", F.concat(_same_shape(body, stream), letters, F.lit("."), top))
            .when(kind == "access_key", F.concat(F.substring(canon, 1, 4), _same_shape(F.substring(canon, 5, 64), stream), digits))
            .when(kind == "iban", F.concat(F.substring(canon, 1, 2), _same_shape(F.substring(canon, 3, 64), stream), digits))
            .when(kind == "ssn", F.concat(F.lit("9"), F.substring(_same_shape(canon, stream), 2, 8), digits))
            .when(kind == "phone", F.concat(_phone(canon, stream), digits))
            .when(kind == "card", F.concat(_card(canon, stream), digits))
            .when(kind == "ip", F.concat(octets, digits))
            .when(kind == "ipv6", F.concat(_ipv6(canon, stream), digits))
            .when(kind == "part", _spelled(_token(kind, canon), stream, attempt, canon.startswith("f:"), canon.startswith("m:")))
            .otherwise(F.concat(_same_shape(canon, stream), letters)))


def fitted(kind: Column, entity: Column, made: Column) -> Column:
    """The surrogate in the grouping of this spelling, behind its prefix."""
    digits = F.concat(F.when((kind == "phone") & entity.startswith("00"), "00").otherwise(""), F.regexp_replace(made, "[^0-9A-Za-z]", ""))
    places = F.transform(_chars(entity), lambda c, i: F.when(
        F.regexp_like(c, F.lit("[0-9A-Za-z]")),
        F.substring(digits, F.length(F.regexp_replace(F.substring(entity, F.lit(1), i + 1), "[^0-9A-Za-z]", "")), F.lit(1))).otherwise(c))
    prefix = F.regexp_extract(entity, f"^({_SECRET})", 1)
    before, behind = _groups(entity)
    short = lambda groups: F.array_join(F.transform(groups, lambda g: F.regexp_replace(g, "^0{1,3}", "")), ":")
    of_full = F.split(made, ":")
    address = F.when(~entity.contains("::"), short(of_full)).otherwise(F.concat(
        short(F.slice(of_full, F.lit(1), F.size(before))), F.lit("::"),
        short(F.slice(of_full, 9 - F.size(behind), F.size(behind)))))
    plain = F.length(F.regexp_replace(entity, "[^0-9A-Za-z]", ""))
    return (F.when(kind.isin(*GROUPED), F.concat(F.array_join(places, ""), F.substring(digits, plain + 1, F.length(digits))))
            .when(kind == "ipv6", address)
            .when(kind == "secret", F.concat(prefix, made)).otherwise(made))


def _clashes(drawn: DataFrame, canons: DataFrame) -> DataFrame:
    """(kind, canon) that must draw again: not the first with a surrogate, or it is an entity."""
    first = drawn.groupBy("kind", "made").agg(F.min("canon").alias("first"), F.count("*").alias("n"))
    shared = drawn.join(first.where("n > 1"), ["kind", "made"]).where("canon != first").select("kind", "canon")
    real = drawn.join(canons.select("kind", _token(F.col("kind"), F.col("canon")).alias("made")).distinct(), ["kind", "made"]).select("kind", "canon")
    return shared.union(real).distinct()


def assign(canons: DataFrame, key: str = KEY) -> DataFrame:
    """canons(kind, canon), distinct -> (kind, canon, attempt, made), made distinct in a kind and none a canon."""
    draw = lambda df: df.withColumn("made", surrogate(F.col("kind"), F.col("canon"), F.col("attempt"), key))
    done = freeze(draw(canons.withColumn("attempt", F.lit(0))))
    while True:
        again = freeze(_clashes(done, canons))
        if again.isEmpty():
            return done
        done = freeze(draw(done.join(again.withColumn("more", F.lit(1)), ["kind", "canon"], "left")
                           .select("kind", "canon", (F.col("attempt") + F.coalesce("more", F.lit(0))).alias("attempt"))))


def replacements(spellings: DataFrame, key: str = KEY) -> DataFrame:
    """spellings(entity, kind, canon) -> (entity, kind, new, mentions): of a name the parts that
    are replaced wherever they stand, as (minus length, token, surrogate)."""
    domain = F.when(F.col("kind") == "email", F.substring_index("canon", "@", -1))
    domains = spellings.select(F.lit("domain").alias("kind"), domain.alias("canon")).where("canon is not null")
    others, names = spellings.where("kind != 'name'"), spellings.where("kind = 'name'")
    parts = names.select("entity", F.posexplode(_parts(F.col("canon"))).alias("nth", "canon"))
    made = assign(others.select("kind", "canon").union(domains).union(parts.select(F.lit("part"), "canon")).distinct(), key)
    of_domain = made.where("kind = 'domain'").select(F.col("canon").alias("domain"), F.col("made").alias("new_domain"))
    new = F.coalesce(F.concat(F.substring_index("made", "@", 1), F.lit("@"), "new_domain"),
                     fitted(F.col("kind"), F.col("entity"), F.col("made")))
    token = _token(F.lit("part"), F.col("canon"))
    mention = F.struct((-F.length(token)).alias("shorter"), token.alias("token"), F.col("made").alias("made"))
    named = (parts.join(made.where("kind = 'part'").drop("kind"), "canon").groupBy("entity")
             .agg(F.array_sort(F.collect_list(F.struct("nth", "made"))).alias("parts"),
                  F.collect_set(F.when(F.length(token) > 1, mention)).alias("mentions"))
             .select("entity", F.lit("name").alias("kind"),
                     F.concat_ws(" ", F.substring_index("entity", " ", 1), F.col("parts.made")).alias("new"), "mentions"))
    return (others.join(made, ["kind", "canon"]).withColumn("domain", domain).join(of_domain, "domain", "left")
            .select("entity", "kind", new.alias("new"), F.lit(None).cast(named.schema["mentions"].dataType).alias("mentions"))
            .unionByName(named))


def _mentions_replaced(text: Column, mentions: Column) -> Column:
    """``text`` with the whole words that are parts of names by their surrogates, long ones first."""
    edge = r"\p{L}\p{M}\p{N}"
    return F.aggregate(mentions, text, lambda done, m: F.when(done.contains(m["token"]), F.regexp_replace(
        done, F.concat(F.lit(f"(?<![{edge}])"), m["token"], F.lit(f"(?![{edge}])")), m["made"])).otherwise(done))


def replace_pii(docs: DataFrame, key: str = KEY, report: bool = False) -> DataFrame:
    """``docs`` with surrogates in ``text``; n_chars, if there is one, set anew. ``report`` adds
    n_entities and kinds (sorted, distinct, comma-joined)."""
    k_id, k_body, found, parts_of, n_entities, kinds = free_names(
        docs.columns, "_k_id", "_k_body", "_found", "_parts", "n_entities", "kinds")
    text = F.col("text")
    has = F.coalesce(F.regexp_like(text, F.lit(HINT)) & F.regexp_like(text, F.lit(PATTERN)), F.lit(False))
    holders = docs.where(has)
    each = holders.select(F.col("doc_id").alias(k_id), F.xxhash64("text").alias(k_body), F.posexplode(
        F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).alias("nth", "entity"))
    kinded = (each.select("entity").distinct().withColumn("kind", kind_of(F.col("entity")))
              .withColumn("canon", canonical(F.col("kind"), value_of(F.col("kind"), F.col("entity")))))
    spellings = freeze(kinded)
    by_entity = replacements(spellings, key)
    gathered = (each.join(by_entity, "entity").groupBy(k_id, k_body)
                .agg(F.array_sort(F.collect_set(F.struct("nth", "new", "kind"))).alias(found),
                     F.array_sort(F.array_distinct(F.flatten(F.collect_list("mentions")))).alias(parts_of)))
    parts = F.split(text, PATTERN, -1)
    parts = F.when(F.size(parts_of) == 0, parts).otherwise(F.transform(parts, lambda p: _mentions_replaced(p, F.col(parts_of))))
    # both arrays are walked once; behind the last part there is no entity
    new = F.array_join(F.zip_with(parts, F.col(found), lambda p, e: F.concat(p, F.coalesce(e["new"], F.lit("")))), "")
    put = (holders.join(gathered, holders["doc_id"].eqNullSafe(F.col(k_id)) & (F.xxhash64(holders["text"]) == F.col(k_body)))
           .withColumn("text", new))
    if report:
        put = (put.withColumn(n_entities, F.size(found).cast("long"))
               .withColumn(kinds, F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda e: e["kind"]))), ",")))
    if "n_chars" in docs.columns:
        put = put.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    rest = docs.where(~has)
    if report:
        rest = rest.withColumn(n_entities, F.lit(0).cast("long")).withColumn(kinds, F.lit(""))
    return put.drop(k_id, k_body, found, parts_of).unionByName(rest)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return replace_pii(docs, report=True).select("doc_id", "n_entities", "kinds", "text")
