"""Surrogates for personal data.

Entities found in texts (e-mail addresses, phone and card numbers, IP addresses, names of persons) are replaced by invented
ones of the same kind: same format and separators, same script and gender of names. A surrogate depends on a secret key, the
kind and the entity's canonical form only, so every mention of an entity, in whatever document and notation, gets the same one.
All distinct entities of the table are then checked: two that share a surrogate, or one whose surrogate is a real entity of the
table, draw again. Only entities that drew again have to be looked up when texts are rewritten; the others are derived in place.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantcast.llm.shared import salted_lookup, stored, text_batches

MAX_DRAWS = 30
# Draw number of an address that is permuted within its network.
PERMUTED = -1
# From this draw on, words and local parts grow, so that short formats can't run out.
LONGER_FROM = 6
KINDS = ("email", "ip", "card", "phone", "given", "surname")

# Common given names by gender and script, titles, and syllables of invented surnames.
GIVEN = {
    ("m", "latin"): "Adam Alexander Andrew Anthony Benjamin Charles Christopher Daniel David Edward Francisco Frederick George Gregory Heinrich Henry Jacques James Javier Jonathan Joseph Juan Jürgen Lawrence Matthew Michael Nicholas Patrick Pierre Richard Robert Samuel Stephen Thomas Timothy William Wolfgang",
    ("f", "latin"): "Alexandra Amanda Angela Barbara Beatrice Brigitte Carmen Caroline Catherine Charlotte Christine Deborah Dorothy Elizabeth Emily Françoise Gabriele Guadalupe Helen Isabella Jennifer Jessica Katharina Linda Margaret Maria Melissa Michelle Monique Patricia Rebecca Samantha Stephanie Susan Ursula Victoria",
    ("m", "cyrillic"): "Александр Алексей Андрей Борис Владимир Григорий Дмитрий Иван Михаил Николай Павел Сергей",
    ("f", "cyrillic"): "Анастасия Валентина Екатерина Елена Ирина Людмила Мария Наталья Ольга Светлана Татьяна Юлия",
}
TITLES = ("Mr", "Mrs", "Ms", "Dr", "Prof", "Herr", "Frau", "Monsieur", "Madame", "Señor", "Señora")
SYLLABLES = {
    "latin": "ba bel bor cal cor dan del dor fal fen gar gol hal hen jor kel lam lin lor mar mel mon nar nel nor pal pen ral ren ros sal sel tar tol van vel wal win zan zel".split(),
    "cyrillic": "ба вел гор дан зор кал лев мар нов пол рос сан тар фед чер шин".split(),
}
_POOLS = {group: names.split() for group, names in GIVEN.items()}
_GROUP_OF = {name.lower(): group for group, names in _POOLS.items() for name in names}
# In lower case, "ms" is a unit.
_WRITTEN = sorted({form for t in TITLES for form in (t, t.upper(), t.lower()) if form != "ms"})
_HINTS = frozenset(_GROUP_OF) | {t.lower() for t in TITLES}

_EMAIL = re.compile(r"(?<![\w.+-])[A-Za-z0-9][\w.+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
_IP = re.compile(r"(?<![\w.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![\w]|\.[0-9])")
_NUMBER = re.compile(r"(?<![\w+.])\+?\(?[0-9](?:[ ().-]{0,2}[0-9]){8,18}(?!\w|\.[0-9])")
_DIGIT = re.compile("[0-9]")
_WORD = re.compile(r"[^\W\d_]+")
_NAME = re.compile(r"(?<!\w)(?:(?P<title>" + "|".join(_WRITTEN) + r")\.? )?(?P<first>[^\W\d_]+)(?: (?P<second>[^\W\d_]+))?")


def luhn_digit(digits: str) -> str:
    """Check digit after ``digits``."""
    total = sum(sum(divmod(2 * int(d), 10)) if i % 2 == 0 else int(d) for i, d in enumerate(reversed(digits)))
    return str(-total % 10)


def _script(word: str) -> str:
    return "cyrillic" if "Ѐ" <= word[0] <= "ӿ" else "latin"


def find_entities(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) in order, without overlaps; earlier kinds win."""
    found: list[tuple[int, int, str]] = []
    covered = bytearray(len(text))

    def add(start: int, end: int, kind: str) -> None:
        if not covered.count(1, start, end):
            covered[start:end] = b"\1" * (end - start)
            found.append((start, end, kind))

    if "@" in text:
        for m in _EMAIL.finditer(text):
            add(*m.span(), "email")
    numbered = _DIGIT.search(text) is not None
    for m in _IP.finditer(text) if numbered else ():
        if all(int(part) < 256 for part in m[0].split(".")):
            add(*m.span(), "ip")
    for m in _NUMBER.finditer(text) if numbered else ():
        digits = re.sub(r"\D", "", m[0])
        if not m[0].startswith("+") and 13 <= len(digits) <= 19 and re.fullmatch(r"\d+|\d{4}(?:[ -]\d{2,6})+", m[0]):
            add(*m.span(), "card")
        elif 10 <= len(digits) <= 15 and (m[0].startswith(("+", "(")) or re.search(r"\d[ ().-]+\d", m[0])):
            add(*m.span(), "phone")
    # The words of the search, so a text without any hint can't hold a name.
    if not _HINTS.isdisjoint(_WORD.findall(text.lower())):
        _find_names(text, add)
    return sorted(found)


def _is_word(char: str) -> bool:
    return char.isalnum() or char == "_"


def _is_given(word: str) -> bool:
    """Whether a capitalised word, or one in capitals, is a listed given name."""
    return word[0].isupper() and word.lower() in _GROUP_OF


def _find_names(text: str, add) -> None:
    """Given names before a capitalised word, and capitalised words after a title or before another of the same name.

    After a title in capitals (``MS``) a surname has to be in capitals too. Surnames are also found where they stand in capitals.
    """
    at, surnames = 0, set()
    while m := _NAME.search(text, at):
        first, second, title = m["first"], m["second"], m["title"]
        at = m.end("first")
        given = _is_given(first)
        if given and second and second[0].isupper() and len(second) > 1 and not _is_given(second):
            add(*m.span("first"), "given")
            add(*m.span("second"), "surname")
            surnames.add(second)
            at = m.end()
        elif title and given:
            add(*m.span("first"), "given")
        elif title and first[0].isupper() and len(first) > 1 and (first.isupper() or not title.isupper()):
            add(*m.span("first"), "surname")
            surnames.add(first)
    forms = surnames | {name.upper() for name in surnames}
    if forms:
        # Whole words of letters, so one walk finds all surnames however many there are.
        for m in _WORD.finditer(text):
            a, b = m.span()
            if m[0] in forms and not (a and _is_word(text[a - 1])) and not (b < len(text) and _is_word(text[b])):
                add(a, b, "surname")


def canonical(mention: str, kind: str) -> str:
    """The form that all mentions of an entity share."""
    if kind == "phone":
        return re.sub(r"\D", "", mention)[-10:]
    if kind == "card":
        return re.sub(r"\D", "", mention)
    if kind == "ip":
        return ".".join(str(int(part)) for part in mention.split("."))
    return mention.lower() if kind in ("email", "given", "surname") else mention


def _stream(secret: bytes, kind: str, value: str, draw: int) -> Iterator[int]:
    block = 0
    while True:
        yield from hmac.new(secret, f"{kind}\0{value}\0{draw}\0{block}".encode(), hashlib.sha256).digest()
        block += 1


def _like(text: str, stream: Iterator[int]) -> str:
    """Letters for letters and digits for digits."""
    return "".join(
        chr(97 + next(stream) % 26) if c.isalpha() else chr(48 + next(stream) % 10) if c.isdigit() else c for c in text
    )


def permuted(secret: bytes, kind: str, number: int, bits: int) -> int:
    """Keyed permutation of the numbers of an even count of bits: four rounds that swap two halves."""
    half = bits // 2
    mask = (1 << half) - 1
    left, right = number >> half, number & mask
    for turn in range(4):
        mixed = hmac.new(secret, f"{kind}\0{bits}\0{turn}\0{right}".encode(), hashlib.sha256).digest()
        left, right = right, left ^ int.from_bytes(mixed[:4], "big") & mask
    return left << half | right


def _kept_octets(value: str) -> int:
    """Octets of an address that tell its kind of network."""
    return 2 if value.startswith("192.168.") else 1 if value.startswith(("10.", "127.")) else 0


def _address(secret: bytes, value: str) -> str:
    """Another address of the same kind of network. The rest of the address is permuted, again as long as it falls into
    another kind, so no two addresses meet however many there are."""
    kept = _kept_octets(value)
    prefix, bits, new = value.split(".")[:kept], 32 - 8 * kept, value
    while True:
        tail = 0
        for part in new.split(".")[kept:]:
            tail = tail << 8 | int(part)
        tail = permuted(secret, "ip", tail, bits)
        new = ".".join([*prefix, *(str(tail >> shift & 255) for shift in range(bits - 8, -1, -8))])
        if _kept_octets(new) == kept:
            return new


def surrogate(secret: bytes, kind: str, value: str, draw: int = 0) -> str:
    """Canonical form of the replacement of an entity."""
    stream = _stream(secret, kind, value, draw)
    if kind == "email":
        local, _, domain = value.rpartition("@")
        *labels, top = domain.split(".")
        longer = "".join(chr(97 + next(stream) % 26) for _ in range(max(0, draw - LONGER_FROM)))
        return _like(local, stream) + longer + "@" + ".".join([_like(".".join(labels), _stream(secret, "domain", domain, 0)), top])
    if kind == "ip":
        if draw == PERMUTED:
            return _address(secret, value)
        kept = _kept_octets(value)
        return ".".join(p if i < kept else str(1 + next(stream) % 254) for i, p in enumerate(value.split(".")))
    if kind == "card":
        body = value[0] + "".join(str(next(stream) % 10) for _ in value[1:-1])
        valid = luhn_digit(value[:-1]) == value[-1]
        return body + (luhn_digit(body) if valid else str(next(stream) % 10))
    if kind == "phone":
        digits = [str(next(stream) % 10) for _ in value]
        for i in (0, 3):
            digits[i] = str(2 + int(digits[i]) % 8)
        return "".join(digits)
    if kind == "given":
        # The next name of the same group in a keyed order, so no two names meet.
        pool = sorted((n.lower() for n in _POOLS[_GROUP_OF[value]]), key=lambda n: hmac.new(secret, n.encode(), hashlib.sha256).digest())
        return pool[(pool.index(value) + 1) % len(pool)]
    syllables = SYLLABLES[_script(value)]
    return "".join(syllables[next(stream) % len(syllables)] for _ in range(3 + max(0, draw - LONGER_FROM)))


def written_like(replacement: str, mention: str, kind: str) -> str:
    """The canonical replacement in the notation of a mention: its separators and country code, or its letter case."""
    if kind in ("phone", "card"):
        digits = iter(replacement)
        total, out = sum(c.isdigit() for c in mention), []
        for c in mention:
            if c.isdigit():
                out.append(c if total > len(replacement) else next(digits))
                total -= 1
            else:
                out.append(c)
        return "".join(out)
    if kind == "ip":
        return replacement
    if mention.isupper():
        return replacement.upper()
    return replacement.capitalize() if mention[:1].isupper() and kind in ("given", "surname") else replacement


def rewrite(text: str, secret: bytes, draws: dict[tuple[str, str], int]) -> tuple[str, str, int]:
    """New text, spans of the entities in the old one as ``kind:start:end``, and their number."""
    parts, spans, at = [], [], 0
    for start, end, kind in find_entities(text):
        mention = text[start:end]
        value = canonical(mention, kind)
        new = surrogate(secret, kind, value, draws.get((kind, value), 0))
        parts += [text[at:start], written_like(new, mention, kind)]
        spans.append(f"{kind}:{start}:{end}")
        at = end
    return "".join(parts) + text[at:], ",".join(spans), len(spans)


def _mentions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = set()
        for row, text in zip(pdf["row"], pdf["text"]):
            rows.update((row, kind, canonical(text[s:e], kind)) for s, e, kind in find_entities(text or ""))
        yield pd.DataFrame(list(rows), columns=["row", "kind", "value"])


def _drawn(secret: bytes):
    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(new=[surrogate(secret, k, v, int(d)) for k, v, d in zip(pdf["kind"], pdf["value"], pdf["draw"])])

    return draw


def drawn_again(entities: DataFrame, secret: bytes) -> DataFrame:
    """``kind``, ``value``, ``draw`` of the entities whose first surrogate is taken. Of those that share one, the smallest value
    keeps it; a surrogate that is itself an entity of the table is taken by that entity. Given names never meet.

    A network with so many addresses that some still meet after ``MAX_DRAWS`` draws takes a permutation of its addresses
    instead: ``draw`` is ``PERMUTED`` for all of them, and distinct ones stay distinct, though one may get another's address."""
    spark = entities.sparkSession
    real = stored(entities.where(F.col("kind") != "given").select("kind", "value"), "entities")
    open_, settled, schema = real.withColumn("draw", F.lit(0)), None, "kind string, value string, draw int, new string"
    for _ in range(MAX_DRAWS):
        fresh = open_.mapInPandas(_drawn(secret), schema)
        every = fresh.withColumn("old", F.lit(1)) if settled is None else fresh.withColumn("old", F.lit(1)).union(settled.withColumn("old", F.lit(0)))
        every = stored(every, "drawn")
        holder = every.groupBy("kind", "new").agg(F.min(F.struct("old", "value")).alias("holder"))
        taken = real.select("kind", F.col("value").alias("new"), F.lit(True).alias("real"))
        judged = every.join(holder, ["kind", "new"]).join(taken, ["kind", "new"], "left")
        bad = (F.col("holder.value") != F.col("value")) | F.col("real").isNotNull()
        judged = stored(judged.select("kind", "value", "draw", "new", bad.alias("bad")), "judged")
        settled = judged.where(~F.col("bad")).drop("bad")
        open_ = judged.where("bad").select("kind", "value", (F.col("draw") + 1).alias("draw"))
        if open_.isEmpty():
            break
    else:
        if not open_.where("kind <> 'ip'").isEmpty():
            raise RuntimeError(f"surrogates still meet after {MAX_DRAWS} draws")
        every = settled.select("kind", "value", "draw").union(open_)
        network = F.regexp_extract("value", r"^(192\.168\.|10\.|127\.)", 1)
        # Four kinds of network at most.
        full = [r[0] for r in open_.select(network).distinct().collect()]
        used_up = (F.col("kind") == "ip") & network.isin(full)
        settled = every.withColumn("draw", F.when(used_up, F.lit(PERMUTED)).otherwise(F.col("draw")))
    return settled.where(F.col("draw") != 0).select("kind", "value", "draw")


def replace_entities(docs: DataFrame, secret: bytes, text: str = "text") -> DataFrame:
    """``docs`` with ``text`` rewritten, ``spans`` (entities in the old text, ``kind:start:end`` in code points) and ``n_entities``.

    Existing columns of these two names are replaced. Null texts stay null and have no entities; repeated rows get equal texts.
    """
    text_batches(docs.sparkSession)
    row = F.xxhash64(F.col(text))
    mentions = docs.select(row.alias("row"), F.col(text).alias("text")).mapInPandas(_mentions, "row long, kind string, value string")
    mentions = stored(mentions.distinct(), "mentions")
    again = drawn_again(mentions.select("kind", "value").distinct(), secret)
    entity = F.xxhash64("kind", "value")
    known = again.select(entity.alias("entity"), F.col("draw"))
    drawn = salted_lookup(mentions.withColumn("entity", entity), known.groupBy("entity").agg(F.max("draw").alias("draw")), "entity", F.col("row"))
    # As many as a text has entities.
    changed = drawn.where(F.col("draw").isNotNull()).groupBy(F.col("row").alias("_row")).agg(F.collect_list(F.struct("kind", "value", "draw")).alias("_draws"))
    changed = stored(changed, "draws")

    @F.pandas_udf("text string, spans string, n_entities int")
    def rewritten(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, draws in batches:
            rows = []
            for t, d in zip(texts, draws):
                chosen = {} if d is None else {(x["kind"], x["value"]): x["draw"] for x in d}
                rows.append((None, "", 0) if t is None else rewrite(t, secret, chosen))
            yield pd.DataFrame(rows, columns=["text", "spans", "n_entities"])

    # The table of redrawn entities is small as long as formats are not nearly used up; the planner knows its size.
    joined = docs.withColumn("_at", row).join(changed, F.col("_at") == F.col("_row"), "left")
    done = joined.withColumn("_new", rewritten(F.col(text), F.col("_draws")))
    return done.withColumns({text: F.col("_new.text"), "spans": F.col("_new.spans"), "n_entities": F.col("_new.n_entities")}).drop("_at", "_row", "_draws", "_new")
