"""Turtle: a tokenizer and parser, a Spark data source over files, and writers."""

from __future__ import annotations

import json
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactum.operators.compose import TRIPLE
from pactum.plans.stage import small
from pactum.terms import PREFIXES

RDF_TYPE = PREFIXES["rdf"] + "type"
XSD = PREFIXES["xsd"]
_FIRST, _REST, _NIL = (PREFIXES["rdf"] + x for x in ("first", "rest", "nil"))

_TOKEN = re.compile(
    r"""(?P<skip>[ \t\r\n]+|\#[^\n]*)
    |(?P<long>\"\"\"(?:[^"\\]|\\.|\"(?!\"\"))*\"\"\"|'''(?:[^'\\]|\\.|'(?!''))*''')
    |(?P<short>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')
    |(?P<iri><[^<>"{}|^`\s]*>)
    |(?P<directive>@prefix\b|@base\b|(?i:PREFIX|BASE)(?=\s))
    |(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
    |(?P<dt>\^\^)
    |(?P<bnode>_:[\w](?:[\w.\-]*[\w\-])?)
    |(?P<number>[+-]?(?:\d+\.\d*[eE][+-]?\d+|\.?\d+[eE][+-]?\d+|\d*\.\d+|\d+))
    |(?P<pname>(?:[^\W\d_][\w.\-]*)?:(?:(?:[\w:%\-]|\\.)(?:(?:[\w:%.\-]|\\.)*(?:[\w:%\-]|\\.))?)?)
    |(?P<word>true\b|false\b|a\b)
    |(?P<punct>[;,.\[\]()])""",
    re.X | re.S,
)
_ESCAPES = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f"}


class TurtleError(ValueError):
    pass


def _unescape(s: str) -> str:
    return re.sub(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", lambda m: chr(int(m[1][1:], 16)) if m[1][0] in "uU" and len(m[1]) > 1 else _ESCAPES.get(m[1], m[1]), s, flags=re.S)


class _Parser:
    def __init__(self, text: str, scope: str, base: str):
        self.scope, self.base, self.prefixes, self.out, self.count = scope, base, {}, [], 0
        self.tokens, at = [], 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise TurtleError(f"unexpected {text[at : at + 20]!r}")
            at = m.end()
            if m.lastgroup != "skip":
                self.tokens.append((m.lastgroup, m.group()))
        self.at = 0

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, value: str | None = None) -> tuple[str, str]:
        t = self.peek()
        if t[0] == "end" or value is not None and t[1] != value:
            raise TurtleError(f"expected {value or 'more'}, found {t[1]!r}")
        self.at += 1
        return t

    def fresh(self) -> tuple[str, str]:
        self.count += 1
        return f"_:{self.scope}#{self.count}", "bnode"

    def resolve(self, iri: str) -> str:
        iri = _unescape(iri[1:-1])
        return iri if re.match(r"[A-Za-z][A-Za-z0-9+.\-]*:", iri) or not self.base else self.base + iri

    def named(self, kind: str, value: str) -> str:
        if kind == "iri":
            return self.resolve(value)
        prefix, _, local = value.partition(":")
        if prefix not in self.prefixes:
            raise TurtleError(f"unknown prefix {prefix!r}")
        return self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local)

    def parse(self) -> list[tuple]:
        while self.peek()[0] != "end":
            kind, value = self.peek()
            if kind == "directive":
                self.take()
                if value.lower().endswith("prefix"):
                    name = self.take()
                    if name[0] != "pname" or not name[1].endswith(":"):
                        raise TurtleError(f"bad prefix {name[1]!r}")
                    self.prefixes[name[1][:-1]] = self.resolve(self.take()[1])
                else:
                    self.base = self.resolve(self.take()[1])
                if value.startswith("@"):
                    self.take(".")
                continue
            bare = value == "["
            subject = self.subject()
            if not (bare and self.peek()[1] == "."):
                self.properties(subject)
            self.take(".")
        return self.out

    def subject(self) -> tuple[str, str]:
        kind, value = self.peek()
        if kind == "bnode" or value in ("[", "("):
            return self.object()[:2]
        if kind not in ("iri", "pname"):
            raise TurtleError(f"bad subject {value!r}")
        self.take()
        return self.named(kind, value), "iri"

    def properties(self, subject: tuple[str, str]) -> None:
        while True:
            kind, value = self.take()
            if value == "a" and kind == "word":
                p = RDF_TYPE
            elif kind in ("iri", "pname"):
                p = self.named(kind, value)
            else:
                raise TurtleError(f"bad predicate {value!r}")
            while True:
                self.out.append((*subject, p, *self.object()))
                if self.peek()[1] != ",":
                    break
                self.take()
            if self.peek()[1] != ";":
                return
            while self.peek()[1] == ";":
                self.take()
            if self.peek()[1] in (".", "]"):
                return

    def object(self) -> tuple[str, str, str | None, str | None]:
        kind, value = self.take()
        if value == "[" and kind == "punct":
            node = self.fresh()
            if self.peek()[1] != "]":
                self.properties(node)
            self.take("]")
            return *node, None, None
        if value == "(" and kind == "punct":
            items = []
            while self.peek()[1] != ")":
                items.append(self.object())
            self.take(")")
            rest: tuple = (_NIL, "iri", None, None)
            for item in reversed(items):
                node = self.fresh()
                self.out += [(*node, _FIRST, *item), (*node, _REST, *rest)]
                rest = (*node, None, None)
            return rest
        if kind == "bnode":
            return f"_:{self.scope}#{value[2:]}", "bnode", None, None
        if kind in ("iri", "pname"):
            return self.named(kind, value), "iri", None, None
        if kind in ("long", "short"):
            text = _unescape(value[3:-3] if kind == "long" else value[1:-1])
            if self.peek()[0] == "lang":
                return text, "literal", self.take()[1][1:].lower(), None
            if self.peek()[0] == "dt":
                self.take()
                return text, "literal", None, self.named(*self.take())
            return text, "literal", None, None
        if kind == "number":
            return value, "literal", None, XSD + ("double" if "e" in value.lower() else "decimal" if "." in value else "integer")
        if kind == "word" and value != "a":
            return value, "literal", None, XSD + "boolean"
        raise TurtleError(f"bad object {value!r}")


def parse_turtle(text: str, scope: str = "doc", base: str = "") -> list[tuple]:
    """(s, s_kind, p, o, o_kind, o_lang, o_dt), each once. A byte-order mark is skipped; blank nodes are named within `scope`."""
    return list(dict.fromkeys(_Parser(text.removeprefix("\ufeff"), scope, base).parse()))


# --- reading and writing ----------------------------------------------------------------------------------------------


def parsed_files(files: DataFrame, mode: str = "PERMISSIVE") -> DataFrame:
    """Triples of (path, content, graph) rows, and a row with an error for each file that can't be parsed. FAILFAST raises instead."""
    schema = f"{TRIPLE}, file string, error string"

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        names = [x.split()[0] for x in schema.split(", ")]
        for pdf in batches:
            rows = []
            for file, content, graph in zip(pdf.path, pdf.content, pdf.graph, strict=True):
                name = file.rsplit("/", 1)[-1].removesuffix(".ttl")
                try:
                    for s, sk, p, o, ok, lang, dt in parse_turtle(bytes(content).decode("utf-8-sig"), name):
                        rows.append((graph, s, sk, p, o, ok, lang, dt, file, None))
                except ValueError as e:
                    if mode == "FAILFAST":
                        raise
                    rows.append((None,) * 8 + (file, str(e)))
            yield pd.DataFrame(rows, columns=names)

    return files.select("path", "content", "graph").mapInPandas(run, schema)


def split_parsed(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Triples, each once, and (file, error) rows."""
    return parsed.filter(F.col("error").isNull()).drop("file", "error").dropDuplicates(), parsed.filter(F.col("error").isNotNull()).select("file", "error")


def _below(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "content")


def read_turtle(spark: SparkSession, path: str, graph: str, mode: str = "PERMISSIVE") -> tuple[DataFrame, DataFrame]:
    """Triples of all files below path, and the files that can't be parsed (file, error).

    Spark lists and reads the files, whole, so any store that it knows will do. A file x.ttl with an x.ttl.graph beside it goes
    to the graph that the latter names, others to `graph`. FAILFAST raises at the first bad file. Both results derive from one
    parse, which a caller that uses both writes first (see staged).
    """
    if mode not in ("PERMISSIVE", "FAILFAST"):
        raise ValueError(f"mode {mode!r}")
    named = _below(spark, path, "*.ttl.graph").select(F.regexp_replace("path", r"\.graph$", "").alias("path"), F.nullif(F.regexp_replace(F.decode("content", "UTF-8"), r"^[\s\x{FEFF}]+|\s+$", ""), F.lit("")).alias("name"))
    files = _below(spark, path, "*.ttl").join(small(named), "path", "left").select("path", "content", F.coalesce("name", F.lit(graph)).alias("graph"))
    return split_parsed(parsed_files(files, mode))


def nt_term(value, kind, lang, dt):
    """A term in N-Triples, as a Spark expression."""
    text = value
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r")):
        text = F.replace(text, F.lit(a), F.lit(b))
    literal = F.concat(F.lit('"'), text, F.lit('"'), F.coalesce(F.concat(F.lit("@"), lang), F.concat(F.lit("^^<"), dt, F.lit(">")), F.lit("")))
    return F.when(kind == "literal", literal).when(kind == "bnode", F.regexp_replace(value, "[^A-Za-z0-9:_]", "x")).otherwise(F.concat(F.lit("<"), value, F.lit(">")))


def to_ntriples(triples: DataFrame) -> DataFrame:
    """One column, value: a line for each triple."""
    none = F.lit(None).cast("string")
    s = nt_term(F.col("s"), F.col("s_kind"), none, none)
    return triples.select(F.concat_ws(" ", s, F.concat(F.lit("<"), F.col("p"), F.lit(">")), nt_term(F.col("o"), F.col("o_kind"), F.col("o_lang"), F.col("o_dt")), F.lit(".")).alias("value"))


def _turtle_term(value: str, kind: str, lang: str | None, dt: str | None, prefixes: dict[str, str]) -> str:
    if kind == "literal":
        text = value.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\r", "\\r")
        return f'"{text}"' + (f"@{lang}" if lang else f"^^{_turtle_term(dt, 'iri', None, None, prefixes)}" if dt else "")
    if kind == "bnode":
        return "_:" + re.sub(r"\W", "x", value[2:])
    for p, ns in prefixes.items():
        if value.startswith(ns) and re.fullmatch(r"[A-Za-z][\w\-]*", value[len(ns) :]):
            return f"{p}:{value[len(ns):]}"
    return f"<{value}>"


def to_turtle(triples: Iterable[tuple], prefixes: dict[str, str] = PREFIXES) -> str:
    by: dict[tuple[str, str], list[str]] = defaultdict(list)
    for s, sk, p, o, ok, lang, dt in triples:
        by[s, sk].append(f"{_turtle_term(p, 'iri', None, None, prefixes)} {_turtle_term(o, ok, lang, dt, prefixes)}")
    head = "".join(f"@prefix {p}: <{ns}> .\n" for p, ns in sorted(prefixes.items()))
    return head + "".join(f"\n{_turtle_term(*k, None, None, prefixes)} " + " ;\n    ".join(sorted(v)) + " .\n" for k, v in sorted(by.items()))


def to_jsonld(triples: Iterable[tuple]) -> str:
    nodes: dict[str, dict] = {}
    for s, _, p, o, ok, lang, dt in triples:
        node = nodes.setdefault(s, {"@id": s})
        if p == RDF_TYPE:
            node.setdefault("@type", []).append(o)
        else:
            value = {"@value": o} | ({"@language": lang} if lang else {}) | ({"@type": dt} if dt else {}) if ok == "literal" else {"@id": o}
            node.setdefault(p, []).append(value)
    return json.dumps([nodes[k] for k in sorted(nodes)], ensure_ascii=False, sort_keys=True)


def flatten_ids(value):
    """{'@id': x} becomes x, at any depth."""
    if isinstance(value, dict):
        return value["@id"] if set(value) == {"@id"} else {k: flatten_ids(v) for k, v in value.items()}
    return [flatten_ids(v) for v in value] if isinstance(value, list) else value


def to_rdfxml(triples: Iterable[tuple]) -> str:
    triples = list(triples)
    spaces = {ns: f"ns{i}" for i, ns in enumerate(sorted({re.sub(r"[^#/:]*$", "", t[2]) for t in triples} - {PREFIXES["rdf"]}))} | {PREFIXES["rdf"]: "rdf"}
    by: dict[tuple[str, str], list[tuple]] = defaultdict(list)
    for t in triples:
        by[t[0], t[1]].append(t)
    label = lambda x: re.sub(r"\W", "x", x[2:])
    out = ['<?xml version="1.0" encoding="UTF-8"?>', "<rdf:RDF " + " ".join(f"xmlns:{p}={quoteattr(ns)}" for ns, p in sorted(spaces.items())) + ">"]
    for (s, sk), rows in sorted(by.items()):
        out.append(f"  <rdf:Description rdf:nodeID={quoteattr(label(s))}>" if sk == "bnode" else f"  <rdf:Description rdf:about={quoteattr(s)}>")
        for _, _, p, o, ok, lang, dt in rows:
            ns = re.sub(r"[^#/:]*$", "", p)
            tag = f"{spaces[ns]}:{p[len(ns):]}"
            if ok == "literal":
                extra = f" xml:lang={quoteattr(lang)}" if lang else f" rdf:datatype={quoteattr(dt)}" if dt else ""
                out.append(f"    <{tag}{extra}>{escape(o)}</{tag}>")
            else:
                out.append(f"    <{tag} rdf:nodeID={quoteattr(label(o))}/>" if ok == "bnode" else f"    <{tag} rdf:resource={quoteattr(o)}/>")
        out.append("  </rdf:Description>")
    return "\n".join([*out, "</rdf:RDF>\n"])
