"""Surrogates for personal data: detected entities get keyed replacements of their own type, format, script and gender.

Every mention of an entity gets the same surrogate in all texts, different entities get different ones, and no
surrogate equals an entity that the corpus holds. Surrogates are drawn from a keyed hash of the entity and an attempt
number; a distributed check of the whole entity table redraws those that collide. Where a format has no free values
left, the entities still open exchange their values by a keyed cyclic permutation of the format.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.scratch import cut, discard, ordered_prefix

#: Draws after which a format counts as full.
ATTEMPTS = 64
#: Surrogates that a task remembers; it only saves drawing them anew.
MEMO = 20_000
#: Forms of address and the gender they tell (n: none).
TITLES = {"Dr": "n", "Prof": "n", "Miss": "f", "Mr": "m", "Mrs": "f", "Ms": "f", "Herr": "m", "Frau": "f", "Monsieur": "m", "Madame": "f", "Mme": "f", "Señor": "m", "Señora": "f", "Sr": "m", "Sra": "f", "г-н": "m", "г-жа": "f", "κ": "m", "κα": "f"}
_TITLE = "|".join(sorted(map(re.escape, TITLES), key=len, reverse=True))
_SECRET = r"(?:sk|pk|ghp|AKIA)[-_A-Z0-9]{16,}"
#: A superset of all detectors below, in Java's and Python's syntax: texts without a match hold no entity. Secrets may have
#: neither a digit nor another sign; word boundaries are left out, since the two languages see them in different places.
#: Looking at the next sign first saves trying each alternative at every place.
TRIGGER = rf"[0-9@]|(?=[sSpPgGaA])(?:[sSpP][kK]|[gG][hH][pP]|[aA][kK][iI][aA])[-_a-zA-Z]{{16}}|[a-fA-F]{{32}}|(?=[{''.join(sorted({t[0] for t in TITLES}))}])(?:{_TITLE})\.? "

_DETECTORS: list[tuple[str, re.Pattern]] = [
    ("secret", re.compile(r"(?ai)(?<=[\"'=: ])(?:[0-9a-f]{32,}|" + _SECRET + r")(?![0-9a-z])")),
    ("email", re.compile(r"[A-Za-z0-9À-ɏ_][A-Za-z0-9À-ɏ._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")),
    ("iban", re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b")),
    ("card", re.compile(r"(?<![\w.+-])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7})(?![\w-])")),
    ("ip", re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?![\w]|\.[0-9])")),
    ("ssn", re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])")),
    ("phone", re.compile(r"(?<![\w.])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?![\w-])")),
    ("person", re.compile(rf"\b(?P<title>{_TITLE})\.? (?P<name>[^\W\d_][\w'’-]*(?: [A-ZÀ-ÞΑ-ΩА-Я][\w'’-]+)?)")),
]


def find(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, type, canonical form) of the entities, in order and without overlap.

    The earlier detector wins; what it took is blanked for the later ones, so that an entity beside it is still seen
    whole. A person is told by a form of address; other mentions of that full name or last name in the text are the
    same person. A name of two words is a "given" name beside the "person" of its last word.
    """
    taken: list[tuple[int, int, str, str]] = []
    left = text
    people: dict[str, str] = {}
    for kind, pattern in _DETECTORS:
        spans = []
        for m in pattern.finditer(left):
            s, e = m.span("name") if kind == "person" else m.span()
            if kind == "person":
                if not text[s].isupper():
                    continue
                gender = TITLES[m.group("title")]
                for name in (text[s:e], text[s:e].split(" ")[-1]):
                    if len(name) > 2:  # shorter ones are often other words
                        people.setdefault(name, gender)
            spans.append((s, e))
            taken.append((s, e, *(_person(text[s:e], gender) if kind == "person" else (kind, canonical(kind, text[s:e])))))
        left = _blanked(left, spans)
    if people:
        bare = re.compile(rf"(?<!\w)(?:{'|'.join(sorted(map(re.escape, people), key=len, reverse=True))})(?!\w)")
        taken += [(m.start(), m.end(), *_person(m.group(), people[m.group()])) for m in bare.finditer(left)]
    return sorted(taken)


def _blanked(text: str, spans: list[tuple[int, int]]) -> str:
    if not spans:
        return text
    ends = [0, *(e for _, e in spans)]
    return "".join(x for (s, e), at in zip(spans, ends, strict=False) for x in (text[at:s], "\0" * (e - s))) + text[ends[-1] :]


def _person(name: str, gender: str) -> tuple[str, str]:
    words = [w.capitalize() for w in name.split(" ")]
    return "given" if len(words) > 1 else "person", f"{gender}:{' '.join(words)}"


def last_name(canon: str) -> str:
    """The canonical person of a given name's last word."""
    gender, _, name = canon.partition(":")
    return f"{gender}:{name.split(' ')[-1]}"


def shown(kind: str, canon: str, surrogate: str) -> str:
    """What must differ between two entities' surrogates of one kind: names as printed, given names beside one last name."""
    if kind == "person":
        return surrogate.partition(":")[2]
    return f"{surrogate.partition(':')[2]} {canon.split(' ')[-1]}" if kind == "given" else surrogate


def canonical(kind: str, value: str) -> str:
    """What mentions of one entity share: digits and letters without separators, and without case where case doesn't count."""
    if kind == "secret":
        return value.lower() if re.fullmatch("(?i)[0-9a-f]+", value) else value
    if kind in ("email", "iban"):
        return value.replace(" ", "").lower()
    if kind == "ip":
        return ".".join(str(int(x)) for x in value.split("."))
    return ("+" if value.startswith("+") else "") + re.sub(r"\D", "", value)


def _stream(key: bytes, *what: str) -> Callable[[int], int]:
    """Numbers below a given one from HMAC-SHA256 over the entity, the same in every run."""
    state = {"n": 0, "bits": 0, "left": 0}

    def draw(below: int) -> int:
        if state["left"] < 64:
            block = hmac.new(key, "\x1f".join([*what, str(state["n"])]).encode(), hashlib.sha256).digest()
            state["n"] += 1
            state["bits"], state["left"] = int.from_bytes(block, "big"), 256
        out = state["bits"] & ((1 << 64) - 1)
        state["bits"] >>= 64
        state["left"] -= 64
        return out % below

    return draw


def _luhn(digits: str) -> int:
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10


def _like(value: str, draw: Callable[[int], int], keep: str = "") -> str:
    """Each letter or digit replaced by one of its own class and case."""
    out = []
    for c in value:
        if c in keep:
            out.append(c)
        elif c.isdigit():
            out.append(str(draw(10)))
        elif "а" <= c.lower() <= "я":
            out.append((chr(ord("а") + draw(32))).upper() if c.isupper() else chr(ord("а") + draw(32)))
        elif "α" <= c.lower() <= "ω":
            out.append("αβγδεζηθικλμνξοπρστυφχψω"[draw(24)].upper() if c.isupper() else "αβγδεζηθικλμνξοπρστυφχψω"[draw(24)])
        elif c.isalpha():
            out.append(chr(ord("A" if c.isupper() else "a") + draw(26)))
        else:
            out.append(c)
    return "".join(out)


#: Syllables of surrogate names and endings that tell the gender, by script.
_SYLLABLES = {"latin": "ba de fi go lu ma ne ri so ta ve zo ka le mi no ra se ti vu".split(), "cyrillic": "ба де фи го лу ма не ри со та ве зо ка ле ми но ра се ти ву".split(), "greek": "βα δε φι γο λυ μα νε ρι σο τα βε ζο κα λε μι νο ρα σε τι βυ".split()}
_ENDINGS = {("latin", "m"): ["n", "s", "r"], ("latin", "f"): ["a", "ia", "na"], ("cyrillic", "m"): ["н", "р", "с"], ("cyrillic", "f"): ["а", "ия", "на"], ("greek", "m"): ["ς", "νος", "ρος"], ("greek", "f"): ["α", "νη", "ρα"]}


def _script(word: str) -> str:
    return "cyrillic" if any("а" <= c.lower() <= "я" for c in word) else "greek" if any("α" <= c.lower() <= "ω" for c in word) else "latin"


def surrogate(kind: str, canon: str, attempt: int, key: bytes) -> str:
    """A canonical surrogate of the entity's own type; other attempts give others."""
    draw = _stream(key, kind, canon, str(attempt))
    if kind == "email":
        local, _, domain = canon.partition("@")
        labels = domain.split(".")
        hosts = _stream(key, "domain", domain)  # one domain keeps one surrogate, whatever the local part
        reserved = labels[-2:] in (["example", "com"], ["example", "org"], ["example", "net"])
        head = [_like(x, hosts) for x in (labels[:-2] if reserved else labels[:-1])]
        return ".".join([_like(local, draw) + "@" + (head[0] if head else labels[0]), *head[1:], *(labels[-2:] if reserved else labels[-1:])]) if head else _like(local, draw) + "@" + domain
    if kind == "secret":
        if re.fullmatch("[0-9a-f]+", canon):
            return "".join("0123456789abcdef"[draw(16)] for _ in canon)
        head = re.match("(?i)(?:sk|pk|ghp|AKIA)", canon).end()
        return canon[:head] + _like(canon[head:], draw)
    if kind == "card":
        body = canon[0] + "".join(str(draw(10)) for _ in canon[2:])
        if _luhn(canon) == 0:
            return body + str((10 - _luhn(body + "0")) % 10)
        last = str(draw(10))
        return body + (last if _luhn(body + last) else str((int(last) + 1) % 10))
    if kind == "ip":
        parts = [int(x) for x in canon.split(".")]
        fixed = 1 if parts[0] in (10, 127) else 2 if parts[:2] == [192, 168] else 0
        return ".".join(str(p) if i < fixed else str(1 + draw(223)) for i, p in enumerate(parts))
    if kind == "iban":
        body = _like(canon[4:].upper(), draw)
        number = int("".join(str(int(c, 36)) for c in body + canon[:2].upper() + "00"))
        return (canon[:2].upper() + f"{98 - number % 97:02d}" + body).lower()
    if kind == "phone":
        lead = len(canon) - 10 if canon.startswith("+") else 0
        lead = max(2 if canon.startswith("+") else 0, lead)
        return canon[:lead] + "".join(str(draw(10)) for _ in canon[lead:])
    if kind in ("person", "given"):
        gender, _, name = canon.partition(":")
        word = name.split(" ")[0]
        script = _script(word)
        stem = "".join(_SYLLABLES[script][draw(20)] for _ in range(max(2, min(5, len(word) // 2)) + attempt // 8))
        ending = _ENDINGS[script, "mf"[draw(2)] if gender == "n" else gender][draw(3)]
        return f"{gender}:{(stem + ending).capitalize()}"
    return "".join(str(draw(10)) for _ in canon)


def dress(kind: str, value: str, canon: str) -> str:
    """The canonical surrogate written in the format of the mention it replaces: separators and case."""
    if kind in ("person", "given"):
        name = canon.partition(":")[2]
        return name.upper() if len(value) > 1 and value.isupper() else name
    if kind == "ip":
        return canon
    if kind in ("email", "secret"):  # as long as the mention, sign by sign
        if kind == "secret" and value != canonical(kind, value) and value.upper() == value:
            return canon.upper()
        if kind == "secret" or len(value) != len(canon):  # a few letters have lower-case forms of two signs
            return canon
        return "".join(d.upper() if c.isupper() else d for c, d in zip(value, canon, strict=True))
    left = iter(canon)
    out = []
    for c in value:
        if c.isalnum() or (c == "+" and kind == "phone"):
            d = next(left)
            out.append(d.upper() if c.isupper() or (value.isupper() and d.isalpha()) else d)
        else:
            out.append(c)
    return "".join(out)


def entities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h1, h2, kind, canon) of each text of a batch, each once."""
    for b in batches:
        seen = {}
        for h1, h2, text in zip(b.column("h1").to_pylist(), b.column("h2").to_pylist(), b.column("_text").to_pylist(), strict=True):
            for _, _, kind, canon in find(text or ""):
                seen[h1, h2, kind, canon] = None
                if kind == "given":
                    seen[h1, h2, "person", last_name(canon)] = None
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*seen, strict=True)], ["h1", "h2", "kind", "canon"])


def assign(found: DataFrame, key: bytes) -> DataFrame:
    """(kind, canon, surrogate, attempt) for each entity: distinct surrogates of each kind as printed, none an entity itself.

    Of entities that draw one surrogate the first by order keeps it and the others draw again; so do those that drew
    an entity of the corpus. Each round is a shuffle by surrogate over what is still open and what is given already.
    ``surrogate`` gives a row's surrogate again from its attempt, which is 0 for all but those that drew again.

    Entities that are open after ATTEMPTS draws have a format whose values are nearly all taken. They get each other's
    values, each the next one's in a keyed order of its format, with attempt -1; a single one gets its format's mask of
    zeros and x. So surrogates stay distinct, though these may be entities of the corpus.
    """
    names = cut(found.select("kind", "canon").distinct(), "entities")

    def run(batches: Iterator[pa.RecordBatch], attempt: int) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kinds, canons = b.column("kind").to_pylist(), b.column("canon").to_pylist()
            drawn = [c if attempt < 0 else surrogate(k, c, attempt, key) for k, c in zip(kinds, canons, strict=True)]
            show = [c.partition(":")[2] if attempt < 0 and k == "given" else shown(k, c, d) for k, c, d in zip(kinds, canons, drawn, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("kind"), b.column("canon"), pa.array(drawn, pa.string()), pa.array(show, pa.string())], ["kind", "canon", "surrogate", "shown"])

    schema = "kind string, canon string, surrogate string, shown string"
    taken = own = cut(names.mapInArrow(lambda b: run(b, -1), schema).select("kind", "shown").distinct(), "taken")
    given, open_ = None, names
    for attempt in range(ATTEMPTS):
        drawn = cut(open_.mapInArrow(lambda b, attempt=attempt: run(b, attempt), schema), "drawn")
        first = drawn.groupBy("kind", "shown").agg(F.min(F.struct("canon", "surrogate")).alias("x"))
        kept = first.join(taken, ["kind", "shown"], "left_anti")
        good = cut(kept.select("kind", "x.canon", "x.surrogate", "shown", F.lit(attempt).alias("attempt")), "good")
        given = good if given is None else given.unionByName(good)
        taken = own.unionByName(given.select("kind", "shown"))
        rest = cut(open_.join(good, ["kind", "canon"], "left_anti"), "open")
        discard(drawn, *([] if open_ is names else [open_]))
        open_ = rest
        if open_.isEmpty():
            return given.drop("shown")
    form = F.when(F.col("kind") == "ip", F.regexp_extract("canon", r"^(10|127|192\.168)\.", 1)).when(F.col("kind").isin("person", "given"), F.substring("canon", 1, 1)).otherwise(F.regexp_replace(F.regexp_replace("canon", r"\d", "0"), r"\p{L}", "x"))
    keyed = open_.select("kind", "canon", form.alias("form"), F.sha2(F.concat(F.lit(key), F.encode("canon", "UTF-8")), 256).alias("h"))
    placed = cut(ordered_prefix(keyed, ["kind", "form", "h", "canon"], [], "full"), "placed")
    ends = placed.groupBy("kind", "form").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    after = placed.select(F.col("pos").alias("next"), F.col("canon").alias("value"))
    asked = placed.join(ends, ["kind", "form"]).select("kind", "canon", "lo", "hi", F.when(F.col("pos") < F.col("hi"), F.col("pos") + 1).otherwise(F.col("lo")).alias("next"))
    mask = F.regexp_replace(F.regexp_replace("canon", r"\d", "0"), r"\p{Ll}", "x")
    value = F.when(F.col("kind") == "given", F.concat(F.substring("value", 1, 2), F.regexp_extract("value", r":(\S+)", 1))).otherwise(F.col("value"))
    last = asked.join(after, "next").select("kind", "canon", F.when(F.col("lo") < F.col("hi"), value).otherwise(mask).alias("surrogate"), F.lit(-1).alias("attempt"))
    return given.drop("shown").unionByName(cut(last, "exchanged"))


class Drawn(dict):
    """Surrogates by (kind, canon), each drawn with its attempt, 0 by default, when it is first asked for; those of full formats are told."""

    def __init__(self, draw: Callable[[str, str, int], str], again: dict[tuple[str, str], tuple[int, str]]):
        super().__init__()
        self.draw, self.again = draw, again

    def __missing__(self, entity: tuple[str, str]) -> str:
        attempt, told = self.again.get(entity, (0, ""))
        self[entity] = told if attempt < 0 else self.draw(*entity, attempt)
        return self[entity]


def rewrite(text: str, table: dict[tuple[str, str], str]) -> str:
    out, at = [], 0
    for s, e, kind, canon in find(text):
        new = table[kind, canon]
        if kind == "given":
            new += " " + table["person", last_name(canon)].partition(":")[2]
        out += [text[at:s], dress(kind, text[s:e], new)]
        at = e
    return "".join([*out, text[at:]])


def replace_entities(docs: DataFrame, key: bytes = b"surrogates-1", text: str = "text") -> DataFrame:
    """docs with the entities of ``text`` replaced; the other columns stay, and ``n_chars``, where docs has it, is counted anew for texts that are looked at.

    Null, empty and entity-free texts stay as they are. A surrogate follows from the key, the entity and the number of
    its attempt, so texts are rewritten where they lie; only the numbers of entities that drew again are joined to
    them, by text hash. A text or entity that very many rows share is one row of the table that is joined.
    """
    names = docs.columns
    row = F.struct(*[F.col(f"`{c}`") for c in names])
    may = F.coalesce(F.col(f"`{text}`").rlike(TRIGGER), F.lit(False))
    look = docs.where(may).select(row.alias("_row"), F.col(f"`{text}`").alias("_text"), F.xxhash64(f"`{text}`").alias("h1"), F.xxhash64(F.lit("second"), f"`{text}`").alias("h2"))
    found = cut(look.select("h1", "h2", "_text").mapInArrow(entities, "h1 long, h2 long, kind string, canon string"), "found")
    again = cut(assign(found, key).where("attempt <> 0").select("kind", "canon", "attempt", F.when(F.col("attempt") < 0, F.col("surrogate")).alias("told")), "again")
    per_text = found.join(again, ["kind", "canon"]).distinct().groupBy("h1", "h2").agg(F.collect_list(F.struct("kind", "canon", "attempt", "told")).alias("table"))
    per_text = cut(per_text, "tables")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drawn = lru_cache(maxsize=MEMO)(lambda kind, canon, attempt: surrogate(kind, canon, attempt, key))
        for b in batches:
            new = []
            for t, table in zip(b.column("_text").to_pylist(), b.column("table").to_pylist(), strict=True):
                new.append(rewrite(t, Drawn(drawn, {(x["kind"], x["canon"]): (x["attempt"], x["told"]) for x in table or ()})))
            yield pa.RecordBatch.from_arrays([b.column("_row"), pa.array(new, pa.string())], ["_row", "_new"])

    schema = T.StructType([T.StructField("_row", docs.schema), T.StructField("_new", T.StringType())])
    done = look.join(per_text, ["h1", "h2"], "left").select("_row", "_text", "table").mapInArrow(run, schema)
    fresh = {text: F.col("_new")} | ({"n_chars": F.length("_new").cast(docs.schema["n_chars"].dataType)} if "n_chars" in names else {})
    changed = done.select(*[fresh.get(c, F.col("_row").getField(c)).alias(c) for c in names])
    return changed.unionByName(docs.where(~may))
