"""Secret scan by assignment-aware lexing.

Source and configuration text is lexed into (name, literal) pairs: quoted
values with escapes, over several lines too, joined by operators or side by
side, bare values and identifiers behind ``=``, ``:``, ``:=``, ``=>``. Inside one
text, constants propagate along names that are assigned from names, however
long the chain. Each literal is scored by how sensitive its target name is, or
a name it flows into, and how much it looks like key material.
Three plain patterns (assignments to sensitive words, access-key ids, long
hex runs) are always reported; literals of the method are added where no
plain span covers them.

Defined results: a null text counts as empty; an empty text has no spans; a
text of any length is scanned whole, as are names, blanks and literals of any
length in it; repeated rows are scanned alike; other
columns pass through ``scan`` untouched unless they clash with its own output
names, which then win.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
# A name, quoted or not, and its operator; repeats are possessive and unbounded, so no text makes them slow.
HEAD = re.compile(r"""(?<![\w.-])["']?([A-Za-z_][\w.-]*+)["']?[\x20\t]*+(?:=>|:=|=(?!=)|:(?!:))[\x20\t]*+""", re.A)
# A quoted term with escapes, over several lines if its marks are three or a backtick, else in one.
QUOTED = re.compile(r'''(?:[rbuf@]{1,2}+(?=["']))?(?:"""((?:[^"\\]++|\\.|"(?!""))*+)"""|"((?:[^"\\\n]++|\\.)*+)"|''' + r"""'''((?:[^'\\]++|\\.|'(?!''))*+)'''|'((?:[^'\\\n]++|\\.)*+)'|`((?:[^`\\]++|\\.)*+)`)""", re.S | re.I)
# A bare term ends before a sign of equality, but for those that fill it up at its end.
BARE = re.compile(r"""[^\s"'`,;(){}\[\]<>=]++(?:=++(?![^\s"'`,;(){}\[\]<>=]))?""")
NAME = re.compile(r"[A-Za-z_][\w.-]*+", re.A)
# A name that is itself assigned or given a type.
CHAINED = re.compile(r"([A-Za-z_][\w.-]*+)[\x20\t]*+(?:=>|:=|=(?!=)|:(?!:))", re.A)
# What joins the terms of one value: an operator with lines broken on either side, or blanks between quoted terms.
JOIN = re.compile(r"\s*+(?:\+|\.\.|&)(?!=)(?:\s|\\)*+")
SIDE_BY_SIDE = re.compile(r"""(?:[\x20\t]|\\\r?\n)*+(?=[rbuf@]{0,2}["'])""", re.I)
IN_BRACKETS = re.compile(r"""\s*+(?=[rbuf@]{0,2}["'])""", re.I)
# Sensitive parts of names and their weight.
SENSITIVE = {
    "password": 3.0, "passwd": 3.0, "pwd": 3.0, "passphrase": 3.0, "secret": 3.0, "token": 2.5, "apikey": 3.0, "credential": 2.5,
    "credentials": 2.5, "private": 1.5, "auth": 1.5, "access": 1.0, "bearer": 2.5, "key": 1.5, "api": 1.0, "signing": 1.5, "encryption": 1.5,
}
HARMLESS = {"public", "id", "name", "path", "file", "url", "size", "count", "length", "type", "hint"}
PLACEHOLDER = re.compile(r"\$\{|\{\{|<[^<>]*+>|%\(|\*{3}|(?i:xxxx|changeme|example|placeholder|your[_-]|dummy|redacted|null|none|true|false)")


def name_parts(name: str) -> list[str]:
    return [p.lower() for p in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+", name)]


def name_score(name: str) -> float:
    parts = name_parts(name)
    return sum(SENSITIVE.get(p, 0.0) for p in set(parts)) - 2.0 * any(p in HARMLESS for p in parts)


def literal_score(value: str) -> float:
    """Bits a character, plus mixed character classes; placeholders and short values fall out."""
    if len(value) < 6 or PLACEHOLDER.search(value):
        return -9.0
    n = len(value)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    classes = sum(any(f(x) for x in value) for f in (str.islower, str.isupper, str.isdigit))
    return entropy - 2.5 + 0.7 * classes + (0.5 if n >= 16 else 0.0) - (2.0 if " " in value else 0.0)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of the plain patterns."""
    low = text.encode("utf-8", "replace").lower()
    out = []
    if any(w in low for w in WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def value_at(text: str, at: int) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]], int]:
    """(literals, bare terms, end) of the value that starts here: terms joined by an operator or, quoted, side by side.

    Quoted terms that follow each other are one literal, from the first one's
    contents to the last one's.
    """
    literals: list[tuple[str, int, int]] = []
    bare: list[tuple[str, int, int]] = []
    parts: list[str] = []
    start = stop = end = at
    between = SIDE_BY_SIDE
    if text.startswith("(", at) and (m := IN_BRACKETS.match(text, at + 1)):
        at, between = m.end(), IN_BRACKETS
    while True:
        if m := QUOTED.match(text, at):
            if not parts:
                start = m.start(m.lastindex)
            parts.append(m[m.lastindex])
            stop, end = m.end(m.lastindex), m.end()
        elif m := CHAINED.match(text, at):
            bare.append((m[1], m.start(), m.end(1)))
            end = m.end(1)
            break
        elif m := BARE.match(text, at):
            if parts:
                literals.append(("".join(parts), start, stop))
                parts = []
            end = m.end()
            if text.startswith(("(", "["), end) and NAME.fullmatch(m[0]):
                break  # a call or an element, no literal
            bare.append((m[0], m.start(), end))
        else:
            break
        # a plus sign can be a part of a bare value; between bare values it needs a blank
        j = JOIN.match(text, end) or (between.match(text, end) if parts else None)
        if j is None or j.end() == end and not parts:
            break
        at = j.end()
    if parts:
        literals.append(("".join(parts), start, stop))
    return literals, bare, end


def lex(text: str) -> list[tuple[str, str, int, int, bool]]:
    """(name, literal, start, end, quoted) of every assignment, of each term of its value; one pass.

    A name that is assigned from a name which is itself assigned, or given a
    type, takes part in both pairs. Comments are read like code, as what is
    commented out is as secret.
    """
    out = []
    at = 0
    while m := HEAD.search(text, at):
        literals, bare, end = value_at(text, m.end())
        out += [(m[1], x, s, e, True) for x, s, e in literals if x]
        out += [(m[1], x, s, e, False) for x, s, e in bare]
        at = max(end, m.end())
        if bare and bare[-1][2] == end:  # a = b = "c", a: str = "c", or a?b="c": go on with the last name of the term
            while at > bare[-1][1] and (text[at - 1].isalnum() or text[at - 1] in "_.-"):
                at -= 1
            at = max(at, m.end())
    return out


def reached(scores: dict[str, float], sources: dict[str, set[str]]) -> dict[str, float]:
    """Of each name the greatest score of the names it flows into; every name and copy is looked at once."""
    best: dict[str, float] = {}
    for name in sorted(scores, key=lambda n: -scores[n]):
        todo = [name]
        while todo:
            n = todo.pop()
            if n not in best:
                best[n] = scores[name]
                todo += sources.get(n, ())
    return best


def literal_spans(text: str, least: float = 3.5) -> list[tuple[int, int]]:
    """Literals whose target name, or a name they reach by propagation, is sensitive."""
    if "=" not in text and ":" not in text:
        return []
    pairs = lex(text)
    if not pairs:
        return []
    names = {name for name, *_ in pairs}
    sources: dict[str, set[str]] = {}
    for name, value, _, _, quoted in pairs:
        if not quoted and NAME.fullmatch(value):
            sources.setdefault(name, set()).add(value)
    best = reached({n: name_score(n) for n in names}, sources)
    found = set()
    for name, value, start, end, quoted in pairs:
        if best[name] >= 2.0 and (quoted or value not in names) and best[name] + literal_score(value) >= least:
            found.add((start, end))
    return sorted(found)


def uncovered(spans: list[tuple[int, int]], base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Those of sorted ``spans`` that no base span overlaps; one merge of both lists."""
    out, k, far = [], 0, -1
    for s, e in spans:
        while k < len(base) and base[k][0] < e:
            far = max(far, base[k][2])
            k += 1
        # base spans that start before a later literal's end may start behind this one's: only those before its end count
        if far <= s:
            out.append((s, e))
    return out


def scan_text(text: str | None) -> dict:
    """All spans of one text; ``spans`` entries are (kind, start, end)."""
    text = text or ""
    base = base_spans(text)
    added = [(s, 3, e) for s, e in uncovered(literal_spans(text), base)]
    names = (*KINDS, "literal")
    show = lambda xs: ",".join(f"{names[k]}:{s}:{e}" for s, k, e in xs)
    return {
        "n_assign": sum(k == 0 for _, k, _ in base), "n_access": sum(k == 1 for _, k, _ in base), "n_hex": sum(k == 2 for _, k, _ in base),
        "base": show(base), "spans": show(sorted(base + added)), "n_literal": len(added), "values": [text[s:e] for s, _, e in sorted(base + added)],
    }


SCHEMA = T.StructType([
    T.StructField("n_assign", T.LongType()), T.StructField("n_access", T.LongType()), T.StructField("n_hex", T.LongType()), T.StructField("n_literal", T.LongType()),
    T.StructField("base", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("values", T.ArrayType(T.StringType())),
])


def scan(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add the span columns to ``keep`` (all other columns by default); one narrow pass, no shuffle."""
    names = [f.name for f in SCHEMA]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in names]
    kept = docs.select(*keep, docs[text].alias("__text")).schema
    out = T.StructType([f for f in kept if f.name != "__text"] + list(SCHEMA))

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(out)
        for batch in batches:
            found = [scan_text(x) for x in batch.column(batch.num_columns - 1).to_pylist()]
            cols = [batch.column(i).cast(schema.field(i).type) for i in range(batch.num_columns - 1)]
            cols += [pa.array([x[n] for x in found], schema.field(n).type) for n in names]
            yield pa.RecordBatch.from_arrays(cols, schema=schema)

    return docs.select(*keep, docs[text].alias("__text")).mapInArrow(run, out)


def digest(scanned: DataFrame) -> DataFrame:
    """The query's columns from ``scan``'s."""
    return scanned.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base"), 256).alias("base_sha256"), "spans", "n_literal")
