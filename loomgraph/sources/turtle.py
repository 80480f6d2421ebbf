"""Turtle and TriG as quads, and quads as Turtle or TriG text.

Reading is one task for each file, since a statement may depend on any prefix
above it: a graph of many files is read in parallel, a single very large one is
better given as N-Triples, whose lines are independent.  Writing is one
aggregation by subject; every row of the text is complete in itself, with whole
IRIs, so the parts of a written folder are documents of their own.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import terms as t
from ..operators.graph_edit import of_keys

#: Nodes in a file that is written.
FILE_NODES = 20_000

_TOKEN = re.compile(
    r"""(?P<skip>\s+|\#[^\n]*)
    |(?P<long>\"\"\"(?:(?:\"|\"\")?(?:[^\"\\]|\\.))*\"\"\"|'''(?:(?:'|'')?(?:[^'\\]|\\.))*''')
    |(?P<string>"(?:[^"\\\n\r]|\\.)*"|'(?:[^'\\\n\r]|\\.)*')
    |(?P<iri><[^\x00-\x20<>"{}|^`\\]*(?:\\[uU][0-9A-Fa-f]+[^\x00-\x20<>"{}|^`\\]*)*>)
    |(?P<directive>@prefix\b|@base\b|(?i:PREFIX|BASE)(?=\s))
    |(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
    |(?P<blank>_:[\w.-]*[\w-])
    |(?P<number>[+-]?(?:\d+\.?\d*[eE][+-]?\d+|\.\d+[eE][+-]?\d+|\d*\.\d+|\d+))
    |(?P<name>(?:[^\W\d_][\w.-]*)?:(?:(?:[\w:%-]|\\[_~.!$&'()*+,;=/?\#@%-])(?:(?:[\w:.%-]|\\[_~.!$&'()*+,;=/?\#@%-])*(?:[\w:%-]|\\[_~.!$&'()*+,;=/?\#@%-]))?)?)
    |(?P<word>[A-Za-z]+)
    |(?P<mark>\^\^|<<\(|\)>>|<<|>>|\{\||\|\}|[.;,\[\](){}~])""",
    re.VERBOSE | re.DOTALL,
)
_ESCAPES = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}
_CODED = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", re.DOTALL)


def _plain(text: str) -> str:
    return _CODED.sub(lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else _ESCAPES.get(m[3], m[3]), text)


def _quoted(text: str) -> str:
    for raw, coded in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = text.replace(raw, coded)
    return f'"{text}"'


class _Reader:
    """Statements of one document as (graph, subject, predicate, object) keys."""

    def __init__(self, text: str, base: str, scope: str) -> None:
        self.tokens, self.ahead = self._scan(text), deque()
        self.base, self.scope = base, scope
        self.prefixes: dict[str, str] = {}
        self.made, self.graph, self.out = 0, None, []

    @staticmethod
    def _scan(text: str) -> Iterator[tuple[str, str]]:
        place = 0
        while place < len(text):
            m = _TOKEN.match(text, place)
            if m is None:
                line = text.count("\n", 0, place) + 1
                raise ValueError(f"line {line}: not Turtle: {text[place : place + 30]!r}")
            place = m.end()
            if m.lastgroup != "skip":
                yield m.lastgroup, m[0]

    def peek(self, ahead: int = 0) -> tuple[str, str]:
        while len(self.ahead) <= ahead:
            self.ahead.append(next(self.tokens, ("end", "")))
        return self.ahead[ahead]

    def take(self, text: str | None = None) -> tuple[str, str]:
        token = self.peek()
        if text is not None and token[1] != text:
            raise ValueError(f"expected {text!r}, found {token[1]!r}")
        self.ahead.popleft()
        return token

    def fresh(self) -> str:
        self.made += 1
        return f"_:{self.scope}g{self.made}"

    def whole(self, token: str) -> str:
        iri = _plain(token[1:-1])
        if re.match("[A-Za-z][A-Za-z0-9+.-]*:", iri):
            return iri
        return urljoin(self.base, iri) + ("#" if iri.endswith("#") else "")

    def named(self, token: str) -> str:
        prefix, local = token.split(":", 1)
        if prefix not in self.prefixes:
            raise ValueError(f"no prefix {prefix!r}")
        return self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local)

    def document(self) -> list[tuple]:
        return [said for some in self.batches() for said in some]

    def batches(self, size: int = 10_000) -> Iterator[list[tuple]]:
        """What the document says, about ``size`` statements at a time."""
        for _ in self.statements():
            if len(self.out) >= size:
                yield self.out
                self.out = []
        yield self.out

    def statements(self) -> Iterator[None]:
        """Reads on, and stops after each statement."""
        while self.peek()[0] != "end":
            kind, text = self.peek()
            if kind == "directive":
                self.directive()
            elif text == "{" or text.upper() == "GRAPH" or (kind in ("iri", "name", "blank") and self.peek(1)[1] == "{"):
                yield from self.block()
            else:
                self.statement()
                self.take(".")
                yield

    def directive(self) -> None:
        _, word = self.take()
        if word.lower().endswith("prefix"):
            name = self.take()[1]
            self.prefixes[name[:-1]] = self.whole(self.take()[1])
        else:
            self.base = self.whole(self.take()[1])
        if word.startswith("@"):
            self.take(".")

    def block(self) -> Iterator[None]:
        if self.peek()[1].upper() == "GRAPH":
            self.take()
        if self.peek()[1] != "{":
            self.graph = self.term()
        self.take("{")
        while self.peek()[1] != "}":
            self.statement()
            if self.peek()[1] == ".":
                self.take()
            yield
        self.take("}")
        self.graph = None

    def statement(self) -> None:
        inline = self.peek()[1] in ("[", "<<")
        subject = self.term()
        if not (inline and self.peek()[1] in (".", "}")):
            self.properties(subject)

    def properties(self, subject: str) -> None:
        while True:
            predicate = self.verb()
            while True:
                said = (subject, predicate, self.term())
                self.out.append((self.graph, *said))
                self.annotations(said)
                if self.peek()[1] != ",":
                    break
                self.take()
            if self.peek()[1] != ";":
                return
            while self.peek()[1] == ";":
                self.take()
            if self.peek()[1] in (".", "]", "}", "|}") or self.peek()[0] == "end":
                return

    def verb(self) -> str:
        if self.peek() == ("word", "a"):
            self.take()
            return f"<{t.TYPE}>"
        return self.term()

    def reified(self, triple: tuple[str, str, str], node: str | None = None) -> str:
        """A node that reifies a triple, the given one or a new one."""
        node = node or self.fresh()
        self.out.append((self.graph, node, f"<{t.REIFIES}>", f"<<( {' '.join(triple)} )>>"))
        return node

    def reifier(self) -> str | None:
        """The node after a ``~``, None if none is named."""
        self.take("~")
        return self.term() if self.peek()[0] in ("iri", "name", "blank") else None

    def annotations(self, triple: tuple[str, str, str]) -> None:
        """Reifiers and annotation blocks after an object."""
        node = None
        while self.peek()[1] in ("~", "{|"):
            if self.peek()[1] == "~":
                node = self.reified(triple, self.reifier())
            else:
                self.take()
                self.properties(node or self.reified(triple))
                self.take("|}")
                node = None

    def term(self) -> str:
        kind, text = self.take()
        if text in ("<<(", "<<"):
            triple = (self.term(), self.verb(), self.term())
            if text == "<<(":
                self.take(")>>")
                return f"<<( {' '.join(triple)} )>>"
            node = self.reified(triple, self.reifier() if self.peek()[1] == "~" else None)
            self.take(">>")
            return node
        if kind == "iri":
            return f"<{self.whole(text)}>"
        if kind == "name":
            return f"<{self.named(text)}>"
        if kind == "blank":
            return f"_:{self.scope}{text[2:]}"
        if kind in ("string", "long"):
            return self.literal(_plain(text[3:-3] if kind == "long" else text[1:-1]))
        if kind == "number":
            name = "double" if "e" in text.lower() else "decimal" if "." in text else "integer"
            return f'"{text}"^^<{t.XSD}{name}>'
        if kind == "word" and text in ("true", "false"):
            return f'"{text}"^^<{t.XSD}boolean>'
        if text == "[":
            node = self.fresh()
            if self.peek()[1] != "]":
                self.properties(node)
            self.take("]")
            return node
        if text == "(":
            items = []
            while self.peek()[1] != ")":
                items.append(self.term())
            self.take(")")
            rest = f"<{t.RDF}nil>"
            for item in reversed(items):
                node = self.fresh()
                self.out += [(self.graph, node, f"<{t.RDF}first>", item), (self.graph, node, f"<{t.RDF}rest>", rest)]
                rest = node
            return rest
        raise ValueError(f"no term: {text!r}")

    def literal(self, text: str) -> str:
        kind, mark = self.peek()
        if kind == "lang":
            self.take()
            return f"{_quoted(text)}@{mark[1:].lower()}"
        if mark == "^^":
            self.take()
            datatype = self.term()
            return _quoted(text) if datatype == f"<{t.XSD}string>" else f"{_quoted(text)}^^{datatype}"
        return _quoted(text)


def read(spark: SparkSession, path: str, base: str = t.BASE, graph: str | None = t.DATA) -> DataFrame:
    """Quads of Turtle or TriG files; triples outside a graph block go to ``graph``.

    Blank labels of different files stay apart.  An error in a file fails the read.
    A task holds the text of a file, but not its tokens, and hands on what it says
    bit by bit.
    """
    schema = pa.schema([(c, pa.string()) for c in ("gk", "sk", "pk", "ok")])

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, text in zip(*batch.columns, strict=True):
                scope = "f" + hashlib.sha256(name.as_py().encode()).hexdigest()[:12] + "-"
                for said in _Reader(text.as_py(), base, scope).batches():
                    columns = list(zip(*said, strict=True)) or [()] * len(schema)
                    yield pa.record_batch([pa.array(c, pa.string()) for c in columns], schema=schema)

    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("name"), "value")
    rows = files.mapInArrow(fn, "gk string, sk string, pk string, ok string")
    return of_keys(rows.select(F.coalesce(F.regexp_extract("gk", "^<(.*)>$", 1), F.lit(graph)).alias("g"), "sk", "pk", "ok"))


def lines(rows: DataFrame, graphs: bool = False) -> DataFrame:
    """One text row for each subject, and graph where ``graphs`` asks for TriG (column value)."""
    subject = t.node_key(F.col("s"), F.col("s_kind"))
    verb = F.when(F.col("p") == t.TYPE, "a").otherwise(t.iri_key(F.col("p")))
    keys = ["g", "s"] if graphs else ["s"]
    said = rows.select("g", subject.alias("s"), F.struct((F.col("p") != t.TYPE).alias("order"), verb.alias("p"), F.col("o_key").alias("o")).alias("said"))
    body = said.groupBy(*keys).agg(F.sort_array(F.collect_set("said")).alias("said"))
    text = F.concat("s", F.lit(" "), F.array_join(F.transform("said", lambda x: F.concat(x["p"], F.lit(" "), x["o"])), " ;\n    "), F.lit(" ."))
    if graphs:
        text = F.when(F.col("g").isNull(), text).otherwise(F.concat(F.lit("<"), "g", F.lit("> {\n"), text, F.lit("\n}")))
    return body.select(text.alias("value"))


def write(rows: DataFrame, folder: str, graphs: bool = False) -> None:
    """Write Turtle, or TriG with ``graphs``, as text files of at most ``FILE_NODES`` nodes, since a file is read by one task."""
    lines(rows, graphs).write.option("maxRecordsPerFile", FILE_NODES).text(folder)
