"""Secret scan by assignment-aware lexing.

Three base patterns find assignments, access keys and long hexadecimal runs anywhere in a text. On top
of them a lexer reads source and configuration syntax into name-literal pairs (``name = "value"``,
``"name": "value"``, ``name: value``, ``export NAME=value``, ``<name>value</name>``, also after a level or a key: ``INFO: NAME=value``;
subscripts, calls with a name and a value, attributes, strings and blocks over several lines, several names at once), carries constants
from the names they are bound to into later names (bare, ``$NAME`` and ``${NAME}``), and scores every literal by the sensitivity of the
name it reaches. Null texts count as empty; an empty text has no spans. Rows are scored one by one, so
repeated rows and ties get equal results, and other columns pass through untouched.
"""

from __future__ import annotations

import math
import re
from collections import Counter, deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, text_or_empty

# The base patterns and the least lengths of what they find.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "lexed")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24

#: How much a part of a name says that its value is secret.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "secret": 1.0, "token": 0.9, "apikey": 1.0, "api_key": 1.0,
    "access_key": 1.0, "accesskey": 1.0, "private_key": 1.0, "privatekey": 1.0, "client_secret": 1.0, "credential": 0.9, "credentials": 0.9,
    "auth": 0.6, "bearer": 0.8, "session_key": 0.8, "encryption_key": 1.0, "signing_key": 1.0, "connection_string": 0.7,
}
#: A literal is reported from this score on: sensitivity of the name times strength of the literal.
THRESHOLD = 0.45

NAME = r"(?<![A-Za-z0-9_.\-])[A-Za-z_][A-Za-z0-9_.\-]*+"
REFERENCE = re.compile(r"\$(?:\{([A-Za-z_][A-Za-z0-9_.\-]*)\}|([A-Za-z_][A-Za-z0-9_]*))")
STRING = r""""(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'"""
PAIR = re.compile(
    rf"""(?P<q>["']?)(?P<name>{NAME})(?P=q)(?:\x20*:\x20*(?P<type>[A-Za-z_][A-Za-z0-9_\[\]]*+))?[\x20\t]*(?P<sep>:=|=>|[:=])[\x20\t]*"""
    rf"""(?P<value>(?:{STRING})(?:[\x20\t]+(?:{STRING}))*|(?:\$\{{[A-Za-z_][A-Za-z0-9_.\-]*\}}|[A-Za-z0-9+/_.=~!@$%^&*-])+)(?P<more>(?:[\x20\t]*\+[\x20\t]*(?:{STRING}|{NAME}))*)"""
    rf"""|<(?P<tag>{NAME})>(?P<inner>[^<>\n]+)</(?P=tag)>"""
)
PART = re.compile(rf"{STRING}|{NAME}")
BARE = r"[A-Za-z0-9+/_.=~!@$%^&*-]+"
#: Other syntaxes that bind a name to a literal: subscripts, calls with a name and a value, attributes, elements with attributes,
#: definitions on a command line, and calls around a literal.
FORMS = re.compile(
    rf"""\[[\x20]*["'](?P<key>{NAME})["'][\x20]*\][\x20]*(?::=|=>|=)[\x20]*(?P<of_key>{STRING}|{BARE})"""
    rf"""|\([\x20]*["'](?P<argument>{NAME})["'][\x20]*,[\x20]*(?P<of_argument>{STRING})"""
    rf"""|\b(?:key|name)=["'](?P<attribute>{NAME})["'][\x20\t\n]+value=(?P<of_attribute>{STRING})"""
    rf"""|<(?P<element>{NAME})\s[^<>]*+>(?P<of_element>[^<>]++)</(?P=element)>"""
    rf"""|(?<![\w-])-D(?P<define>[A-Za-z_][A-Za-z0-9_.\-]*+)=(?P<of_define>{STRING}|{BARE})"""
    rf"""|(?P<called>{NAME})[\x20]*(?::=|=)[\x20]*[A-Za-z_][A-Za-z0-9_.]*+\([\x20]*(?P<of_called>{STRING})"""
)
#: Where strings over several lines begin, blocks of indented lines, and names that several values are given to.
LONG_STRING = re.compile(rf"""(?P<name>{NAME})["']?[\x20\t]*(?::=|[:=])[\x20\t]*[rbfuRBFU]{{0,2}}(?P<quote>\"""|\'\'\'|`)""")
BLOCK = re.compile(rf"""^[\x20]*(?:-[\x20]+)?["']?(?P<name>{NAME})["']?:[\x20]*[|>][+-]?[0-9]?[\x20]*$""", re.MULTILINE)
SEVERAL = re.compile(rf"""(?<!,)(?<!,\x20)(?P<names>{NAME}(?:[\x20]*,[\x20]*{NAME})++)[\x20]*=[\x20]*(?P<values>(?:{STRING}|[A-Za-z0-9_.+-]+)(?:[\x20]*,[\x20]*(?:{STRING}|[A-Za-z0-9_.+-]+))+)""")
SEVERAL_VALUES = re.compile(rf"{STRING}|[A-Za-z0-9_.+-]+")
CAMEL = re.compile(r"([a-z0-9])([A-Z])")
MANY = 1_000_000


def sensitivity(name: str) -> float:
    """0 to 1: how sensitive a value with this name is; the name's words are compared, alone and in pairs."""
    words = [w for w in re.split(r"[_.\-]+", CAMEL.sub(r"\1_\2", name).lower()) if w]
    return max([0.0, *(SENSITIVE.get(w, 0.0) for w in words), *(SENSITIVE.get(f"{a}_{b}", 0.0) for a, b in zip(words, words[1:]))])


class Value:
    """What a name is bound to: its first character, how often it holds each character, and the literals and constants it
    is made of. Joined strings aren't kept, so that constants built of constants stay small."""

    __slots__ = ("first", "counted", "waiting", "parts", "score")

    def __init__(self) -> None:
        self.first, self.counted, self.waiting, self.parts, self.score = "", Counter(), [], [], 0.0

    def add(self, text: str, start: int, end: int) -> None:
        self.first = self.first or text[start : min(start + 1, end)]
        self.waiting.append((text, start, end))
        self.parts.append((start, end))

    @property
    def counts(self) -> Counter:
        """Characters are counted when asked for: most names are neither sensitive nor used again."""
        for text, start, end in self.waiting:
            self.counted.update(text[start:end])
        self.waiting.clear()
        return self.counted

    def join(self, other: Value) -> None:
        self.first = self.first or other.first
        counts = self.counts
        for c, n in other.counts.items():
            counts[c] = min(MANY, counts[c] + n)
        self.parts.append(other)

    def refer(self, text: str, start: int, *known: dict[str, Value]) -> None:
        """Add a text in which $NAME and ${NAME} stand for the values of known names. What it holds besides is reported whole."""
        last, rest = 0, False
        for r in REFERENCE.finditer(text):
            value = next((k[r[1] or r[2]] for k in known if (r[1] or r[2]) in k), None)
            if value:
                self.first = self.first or text[last : last + 1] if r.start() > last else self.first
                self.counts.update(text[last : r.start()])
                rest, last = rest or r.start() > last, r.end()
                self.join(value)
        self.first = self.first or text[last : last + 1]
        self.counts.update(text[last:])
        if rest or last < len(text):
            self.parts.append((start, start + len(text)))


def strength(value: str | Value) -> float:
    """0 to 1: how little a literal looks like a plain word, by its bits of entropy and kinds of characters."""
    if isinstance(value, str):
        whole, value = value, Value()
        value.add(whole, 0, len(whole))
    counts, first = value.counts, value.first
    n = sum(counts.values())
    if n < MIN_ASSIGN or first in "<$%{" or len(counts) < 4:
        return 0.0
    upper = sum(k for c, k in counts.items() if c.isupper())
    if all(c.isascii() and c.isalpha() for c in counts) and (upper in (0, n) or upper == 1 and first.isupper()):
        return 0.0
    # From MANY characters on, four of them different, there are more than 40 bits.
    bits = -sum(c / n * math.log2(c / n) for c in counts.values()) * n if n < MANY else 40.0
    kinds = any(c.islower() for c in counts) + any(c.isupper() for c in counts) + any(c.isdigit() for c in counts) + any(not c.isalnum() for c in counts)
    return min(1.0, bits / 40) * (0.4 + 0.2 * min(3, kinds))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the base patterns, by start and then kind."""
    out = []
    low = text.lower()
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        out += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    out += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[0], x[2]))


def unquoted(raw: str) -> str:
    return raw[1:-1] if len(raw) > 1 and raw[0] in "\"'" and raw[-1] == raw[0] else raw


def other_pairs(text: str) -> list[tuple[int, str, list[tuple[int, int]]]]:
    """(end, name, spans of its literal's parts) of the syntaxes of FORMS and of those that a single expression doesn't read."""
    out = []
    for m in FORMS.finditer(text):
        kind = next(k for k in ("key", "argument", "attribute", "element", "define", "called") if m[k])
        s, e = m.span(f"of_{kind}")
        quoted = m[f"of_{kind}"][0] in "\"'" and kind != "element"
        out.append((m.end(), m[kind], [(s + quoted, e - quoted)]))
    unclosed = set()
    at = 0
    while m := LONG_STRING.search(text, at):
        quote, at = m["quote"], m.end()
        end = -1 if quote in unclosed else text.find(quote, at)
        if end < 0:  # nor is any later one closed
            unclosed.add(quote)
            continue
        out.append((end, m["name"], [(at, end)]))
        at = end + len(quote)
    for m in BLOCK.finditer(text):
        column = m.start("name") - m.start() - (text[m.start("name") - 1] in "\"'")
        parts, s = [], m.end() + 1
        while s < len(text):
            e = text.find("\n", s)
            e = len(text) if e < 0 else e
            line = text[s:e]
            if line.strip() and len(line) - len(line.lstrip(" ")) <= column:
                break
            if line.strip():
                parts.append((s + len(line) - len(line.lstrip()), s + len(line.rstrip())))
            s = e + 1
        out.append((s, m["name"], parts))
    for m in SEVERAL.finditer(text):
        for name, v in zip(re.findall(NAME, m["names"]), SEVERAL_VALUES.finditer(m["values"])):
            quoted = v[0][0] in "\"'"
            s = m.start("values") + v.start() + quoted
            out.append((m.end(), name, [(s, s + len(v[0]) - 2 * quoted)]))
    return sorted(out, key=lambda x: x[0])


def lexed_spans(text: str) -> list[tuple[int, int, float]]:
    """(start, end, score) of literals that reach a sensitive name, directly or through constants."""
    if not any(c in text for c in "=:<("):
        return []
    literals: dict[str, Value] = {}
    aside: dict[str, Value] = {}  # of names after a colon: types, maybe, which bare names aren't taken for
    values: list[Value] = []
    at, inside = 0, 0
    others = deque(other_pairs(text))
    while (m := PAIR.search(text, at)) or others:
        if others and (m is None or others[0][0] <= m.start()):
            # Names are known from where their pair ends.
            _, name, spans = others.popleft()
            value = Value()
            for s, e in spans:
                value.add(text, s, e)
            literals[name] = value
            score = sensitivity(name)
            score = score * strength(value) if score else 0.0
            value.score = score if score >= THRESHOLD else 0.0
            values.append(value)
            continue
        known = aside if m.start() < inside else literals
        # What looks like a type or a bare value may be the name of a pair of its own: `INFO: NAME=value`, `a = NAME = value`.
        at = inside = m.end()
        if m["type"] or not m["tag"] and not m["more"] and m["value"][0] not in "\"'":
            at = m.start("type") if m["type"] else m.start("value")
            inside = m.end() if m["sep"] == ":" or m["type"] else 0
        if m["tag"]:
            name, parts = m["tag"], [(m["inner"], m.start("inner"), True)]
        else:
            name, raw = m["name"], m["value"]
            quoted = raw[0] in "\"'"
            parts = [(unquoted(p[0]), m.start("value") + p.start() + 1, True) for p in PART.finditer(raw)] if quoted else [(raw, m.start("value"), False)]
            parts += [(unquoted(p[0]), m.start("more") + p.start() + (p[0][0] in "\"'"), p[0][0] in "\"'") for p in PART.finditer(m["more"] or "")]
        value = Value()
        plain = 0.0
        for part, start, quoted in parts:
            if not quoted and part in literals:  # a constant bound before
                value.join(literals[part])
            elif "$" in part and any((r[1] or r[2]) in literals or (r[1] or r[2]) in aside for r in REFERENCE.finditer(part)):
                plain = max(plain, strength(part))
                value.refer(part, start, literals, aside)
            else:
                value.add(text, start, start + len(part))
        known[name] = value
        weight = sensitivity(name)
        score = weight * max(plain, strength(value)) if weight else 0.0
        value.score = score if score >= THRESHOLD else 0.0
        values.append(value)
    # Constants are older than what is made of them: from the last one back, each gives its score to its parts.
    best: dict[tuple[int, int], float] = {}
    for value in reversed(values):
        for part in value.parts if value.score else ():
            if isinstance(part, Value):
                part.score = max(part.score, value.score)
            elif part[1] > part[0]:
                best[part] = max(best.get(part, 0.0), value.score)
    return sorted((s, e, v) for (s, e), v in best.items())


def scan(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, float]]]:
    """Base spans, and those that only the lexer finds (none that lies inside a base span)."""
    base = base_spans(text)
    lexed, i, reach = [], 0, -1
    for x in lexed_spans(text):
        while i < len(base) and base[i][0] <= x[0]:
            reach, i = max(reach, base[i][1]), i + 1
        if x[1] > reach:
            lexed.append(x)
    return base, lexed


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])


def find_secrets(df: DataFrame, text: str = "text", into: str = "secrets") -> DataFrame:
    """df with a column `into`: array of struct(kind, start, end, score) by start, then kind. Code points, end exclusive."""
    from pyspark.sql.pandas.types import from_arrow_type, to_arrow_schema
    from pyspark.sql.types import ArrayType, StructField, StructType

    schema = StructType([f for f in df.schema.fields if f.name != into] + [StructField(into, ArrayType(from_arrow_type(SPAN)))])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for t in b.column(b.schema.get_field_index(text)).to_pylist():
                base, lexed = scan(t or "")
                all_ = sorted([(s, e, k, 1.0) for s, e, k in base] + [(s, e, 3, v) for s, e, v in lexed], key=lambda x: (x[0], x[2]))
                found.append([{"kind": KINDS[k], "start": s, "end": e, "score": v} for s, e, k, v in all_])
            columns = [b.column(b.schema.get_field_index(f.name)) for f in schema.fields[:-1]]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found, pa.list_(SPAN))], schema=pa.schema([*(b.schema.field(f.name) for f in schema.fields[:-1]), arrow.field(into)]))

    return mapped(df, run, schema)


def redact(df: DataFrame, text: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """df with every found span of the text replaced by the mask; overlapping spans are masked as one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index(text)
            out = []
            for t in b.column(at).to_pylist():
                if t:
                    base, lexed = scan(t)
                    pieces, last = [], 0
                    for s, e in sorted([x[:2] for x in base] + [x[:2] for x in lexed]):
                        if s >= last:
                            pieces += [t[last:s], mask]
                        last = max(last, e)
                    t = "".join(pieces) + t[last:] if pieces else t
                out.append(t)
            yield b.set_column(at, b.schema.field(at), pa.array(out, b.schema.field(at).type))

    return mapped(df, run, df.schema)


def secret_digest(docs: DataFrame) -> DataFrame:
    """Per document: counts of the base kinds, a digest of the base spans, and all spans as text."""
    from pyspark.sql import types as T

    found = find_secrets(docs.select("doc_id", text_or_empty().alias("text"))).drop("text")
    line = lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])
    base = F.filter("secrets", lambda x: x["kind"] != "lexed")
    count = lambda kind: F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast(T.LongType())
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(F.concat_ws(",", F.transform(base, line)), 256).alias("base_sha256"), F.concat_ws(",", F.transform("secrets", line)).alias("spans"),
        count("lexed").alias("n_lexed"),
    )

