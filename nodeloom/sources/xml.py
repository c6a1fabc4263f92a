"""Shredding documents into the node table, one row per node.

``pre`` is document order, ``size`` the number of rows below, attributes stand right after
their element. Expat and html.parser run inside ``mapInArrow``, a document at a time.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DOC, ELEM, ATTR, TEXT, COMMENT, PI = 0, 1, 2, 3, 4, 5

NODES = "doc_id long, pre long, size long, level int, parent long, kind int, ns_uri string, local string, prefix string, sib_ord int, value string, attrs map<string,string>, declared map<string,string>"
DOCS = "doc_id long, encoding string, version string, standalone boolean, wellformed boolean, error string, line int, col int"
#: As they are stored: attributes without rows of their own. named: (uri, local, prefix) of the attributes, where one has a namespace.
TREES = NODES + ", named array<struct<ns_uri:string,local:string,prefix:string>>"
_NAMES = [x.split()[0] for x in NODES.split(", ")]
_KINDS = [x.split()[1] for x in NODES.split(", ")]
_TREE_NAMES = [*_NAMES, "named"]
_NAMED = pa.list_(pa.struct([(x, pa.string()) for x in ("ns_uri", "local", "prefix")]))
_TYPES = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "map<string,string>": pa.map_(pa.string(), pa.string())}


class _Names(dict):
    """(uri, local, prefix) of names as expat gives them."""

    def __init__(self):
        self.seen: dict[tuple, tuple] = {}

    def __missing__(self, name: str) -> tuple:
        self[name] = out = _name(name)
        return out

    def attributes(self, given: tuple) -> tuple[list[str], list[tuple] | None]:
        """Keys of an element's attributes, and their names where one has a namespace."""
        found = self.seen.get(given)
        if found is None:
            if len(self.seen) > 10_000:
                self.seen.clear()
            named = [_name(n) for n in given]
            found = self.seen[given] = [f"{{{u}}}{n}" if u else n for u, n, _ in named], named if any(u for u, _, _ in named) else None
        return found


class _Tree:
    """Columns of nodes while documents are parsed. Attributes stand with their element: keys and values, and their names where a key does not tell them."""

    def __init__(self, strip: bool = False):
        self.strip, self.columns = strip, [[] for _ in range(11)]
        self.ids, self.pre, self.size, self.level, self.parent, self.kind, self.uri, self.local, self.prefix, self.order, self.value = self.columns
        self.declared, self.named, self.keys, self.values, self.ends = [], [], [], [], []
        self.text: list[str] = []

    def begin(self, doc_id: int) -> None:
        self.doc_id, self.next = doc_id, 0
        self.text.clear()
        self.mark = len(self.ids), len(self.keys)
        self.open, self.children = [], [0]
        self.add(DOC, None, None, None, None)
        self.open, self.at, self.children = [0], [self.mark[0]], [0]

    def add(self, kind: int, uri: str | None, local: str | None, prefix: str | None, value: str | None) -> int:
        pre, up = self.next, self.open
        self.next = pre + 1
        self.children[-1] += 1
        self.ids.append(self.doc_id)
        self.pre.append(pre)
        self.size.append(0)
        self.level.append(len(up))
        self.parent.append(up[-1] if up else None)
        self.kind.append(kind)
        self.uri.append(uri)
        self.local.append(local)
        self.prefix.append(prefix)
        self.order.append(self.children[-1])
        self.value.append(value)
        self.declared.append(None)
        self.named.append(None)
        self.ends.append(len(self.keys))
        return pre

    def flush(self) -> None:
        text = "".join(self.text)
        self.text.clear()  # handlers hold on to the list
        if text and not (self.strip and not text.strip(" \t\r\n")) and len(self.open) > 1:
            self.add(TEXT, None, None, None, text)

    def start(self, name: tuple, keys: list[str], values: list[str], named: list[tuple] | None = None, declared: list | None = None) -> None:
        """keys of attributes: local name or {uri}name; named: their (uri, local, prefix), where one has a namespace or looks so; declared: the namespaces that the element declares, by prefix."""
        if self.text:
            self.flush()
        pre = self.add(ELEM, *name, None)
        self.open.append(pre)
        self.at.append(len(self.ids) - 1)
        self.children.append(0)
        if declared:
            self.declared[-1] = declared
        if keys:
            self.keys += keys
            self.values += values
            self.ends[-1] = len(self.keys)
            self.named[-1] = named
            self.next += len(keys)

    def end(self) -> None:
        if self.text:
            self.flush()
        pre = self.open.pop()
        self.children.pop()
        self.size[self.at.pop()] = self.next - 1 - pre

    def leaf(self, kind: int, value: str, name: str | None = None) -> None:
        self.flush()
        self.add(kind, None, name, None, value)

    def finish(self) -> None:
        self.flush()
        while self.open:
            self.end()

    def drop(self) -> None:
        """The document goes."""
        rows, attrs = self.mark
        for c in (*self.columns, self.declared, self.named, self.ends):
            del c[rows:]
        del self.keys[attrs:], self.values[attrs:]

    def attributes(self, i: int) -> list[tuple[str, str]] | None:
        a, b = self.ends[i - 1] if i else 0, self.ends[i]
        return [*zip(self.keys[a:b], self.values[a:b], strict=True)] or None

    def rows(self) -> list[list]:
        """Rows of the node table, with the attributes."""
        out = []
        for i, r in enumerate(zip(*self.columns, strict=True)):
            attrs = self.attributes(i)
            out.append([*r, attrs, self.declared[i]])
            for j, (k, v) in enumerate(attrs or ()):
                out.append([r[0], r[1] + 1 + j, 0, r[3] + 1, r[1], ATTR, *(self.named[i][j] if self.named[i] else ("", k, "")), None, v, None, None])
        return out

    def batch(self) -> pa.RecordBatch:
        """The columns of ``TREES``; they are empty then."""
        n = len(self.ids)
        held = [i for i in range(n) if self.ends[i] == (self.ends[i - 1] if i else 0)]
        offsets: list = [0, *self.ends]
        for i in held:
            offsets[i] = None  # no map
        maps = pa.MapArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(self.keys, pa.string()), pa.array(self.values, pa.string()))
        made = [pa.array(c, _TYPES[t]) for c, t in zip(self.columns, _KINDS, strict=False)]
        out = pa.RecordBatch.from_arrays([*made, maps, pa.array(self.declared, _TYPES["map<string,string>"]), pa.array(self.named, _NAMED)], _TREE_NAMES)
        for c in (*self.columns, self.declared, self.named, self.ends, self.keys, self.values):
            c.clear()
        return out


def _name(name: str) -> tuple:
    parts = name.split("\x1f")
    return (parts[0], parts[1], parts[2] if len(parts) > 2 else "") if len(parts) > 1 else ("", parts[0], "")


def parse_xml(doc_id: int, text: str | bytes, recover: bool = False, strip: bool = False) -> tuple[list[list], dict]:
    """(rows, facts) of one document. Not well-formed: no rows, or those before the error with ``recover``. External entities are not read."""
    tree = _Tree(strip)
    facts = _xml_into(tree, _Names(), doc_id, text, recover)
    return tree.rows(), facts


def _xml_into(tree: _Tree, names: _Names, doc_id: int, text: str | bytes, recover: bool = False) -> dict:
    tree.begin(doc_id)
    facts = {"encoding": None, "version": None, "standalone": None, "wellformed": True, "error": None, "line": None, "col": None}
    p = expat.ParserCreate(namespace_separator="\x1f")
    p.namespace_prefixes = True
    p.buffer_text = True
    p.ordered_attributes = True

    declared: list[tuple[str, str]] = []

    def start(name, attrs):
        if attrs:
            keys, named = names.attributes(tuple(attrs[::2]))
            tree.start(names[name], keys, attrs[1::2], named, [*declared])
        else:
            tree.start(names[name], (), (), None, [*declared])
        declared.clear()

    def end(_):
        tree.end()

    p.StartElementHandler, p.EndElementHandler = start, end
    p.StartNamespaceDeclHandler = lambda prefix, uri: declared.append((prefix or "", uri or ""))
    p.CharacterDataHandler = tree.text.append
    p.CommentHandler = lambda v: tree.leaf(COMMENT, v)
    p.ProcessingInstructionHandler = lambda target, v: tree.leaf(PI, v, target)
    p.XmlDeclHandler = lambda v, e, s: facts.update(version=v, encoding=e, standalone=None if s < 0 else bool(s))
    p.ExternalEntityRefHandler = lambda *_: 0
    try:
        p.Parse(text, True)
    except expat.ExpatError as e:
        facts |= {"wellformed": False, "error": expat.ErrorString(e.code), "line": e.lineno, "col": e.offset}
        if not recover:
            tree.drop()
            return facts
    tree.finish()
    return facts


#: Elements without content, and elements whose start closes an open one.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {x: {"p"} for x in "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()} | {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"},
}
_SCOPE = frozenset("ul ol table dl select body html div article".split())
_IN_HEAD = frozenset("title meta link base style script".split())


class _Html(HTMLParser):
    def __init__(self, tree: _Tree):
        super().__init__(convert_charrefs=True)
        self.tree, self.names = tree, []

    def _imply(self, tag: str | None) -> None:
        if not self.names and tag != "html":
            self._open("html", [])
        if len(self.names) == 1 and tag not in ("head", "body", "html"):
            self._open("head" if tag in _IN_HEAD else "body", [])
        elif self.names[1:2] == ["head"] and len(self.names) == 2 and tag not in _IN_HEAD and tag != "head":
            self._close()
            if tag != "body":
                self._open("body", [])

    def _open(self, tag, attrs):
        self.names.append(tag)
        held = dict(attrs)
        named = [("", n, "") for n in held] if any(n.startswith("{") for n in held) else None
        self.tree.start(("", tag, ""), [*held], [v if v is not None else n for n, v in held.items()], named)

    def _close(self):
        self.names.pop()
        self.tree.end()

    def handle_starttag(self, tag, attrs):
        if tag in ("html", "head", "body") and tag in self.names:
            return
        for i in range(len(self.names) - 1, -1, -1):
            if self.names[i] in CLOSES.get(tag, ()):
                while len(self.names) > i:
                    self._close()
                break
            if self.names[i] in _SCOPE:
                break
        self._imply(tag)
        self._open(tag, attrs)
        if tag in VOID:
            self._close()

    def handle_endtag(self, tag):
        if tag in self.names and tag not in VOID:
            while self.names[-1] != tag:
                self._close()
            self._close()

    def handle_data(self, data):
        if data.strip():
            self._imply(None)
        if self.names:
            self.tree.text.append(data)

    def handle_comment(self, data):
        self.tree.leaf(COMMENT, data)


def parse_html(doc_id: int, text: str) -> list[list]:
    """Rows of an HTML page: names in lower case, implied html, head and body, optional end tags supplied."""
    tree = _Tree()
    _html_into(tree, doc_id, text)
    return tree.rows()


def _html_into(tree: _Tree, doc_id: int, text: str) -> None:
    tree.begin(doc_id)
    parser = _Html(tree)
    parser.feed(text)
    parser.close()
    tree.finish()


def _batch(rows: list[list], spec: str) -> pa.RecordBatch:
    fields = [x.split() for x in spec.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, _TYPES[t]) for c, (_, t) in zip(columns, fields, strict=True)], [n for n, _ in fields])


ROWS_AT_ONCE = 50_000


def trees(docs: DataFrame, id_col: str = "doc_id", text_col: str = "xml", html: bool = False, recover: bool = False, strip: bool = False) -> DataFrame:
    """Nodes of (id, text) rows without rows for attributes, which elements carry: ``TREES``. Documents that are not well-formed give no nodes, or what precedes the error with ``recover``."""

    def run(batches):
        tree, names = _Tree(strip), _Names()
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                text = text.as_py()
                if text is None:
                    continue
                if html:
                    _html_into(tree, doc_id.as_py(), text)
                else:
                    _xml_into(tree, names, doc_id.as_py(), text, recover)
                if len(tree.ids) + len(tree.keys) > ROWS_AT_ONCE:
                    yield tree.batch()
        yield tree.batch()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(run, TREES)


def _attribute(e: Column, i: Column) -> dict[str, Column]:
    """Columns of the attribute with entry ``e`` of the map, in place ``i``."""
    name = lambda part, plain: F.coalesce(F.col("named")[i][part], plain)
    null = lambda kind: F.lit(None).cast(kind)
    return {
        "doc_id": F.col("doc_id"), "pre": F.col("pre") + 1 + i, "size": F.lit(0).cast("long"), "level": F.col("level") + 1, "parent": F.col("pre"), "kind": F.lit(ATTR),
        "ns_uri": name("ns_uri", F.lit("")), "local": name("local", e["key"]), "prefix": name("prefix", F.lit("")), "sib_ord": null("int"), "value": e["value"], "attrs": null("map<string,string>"), "declared": null("map<string,string>"),
    }


def node_table(stored: DataFrame) -> DataFrame:
    """The node table of stored ``TREES``. Rows of attributes are made on reading, from the maps of their elements; a filter by kind leaves one of the two parts."""
    # explode, not posexplode: only of it Catalyst knows that nothing comes from no rows, and drops the part
    numbered = F.transform(F.map_entries("attrs"), lambda e, i: F.struct(i.alias("i"), e.alias("e")))
    held = stored.where(F.col("attrs").isNotNull()).select("doc_id", "pre", "level", "named", F.explode(numbered).alias("__a"))
    return stored.select(*_NAMES).unionByName(held.select(*[c.alias(k) for k, c in _attribute(F.col("__a.e"), F.col("__a.i")).items()]))


def shred(docs: DataFrame, id_col: str = "doc_id", text_col: str = "xml", html: bool = False, recover: bool = False, strip: bool = False) -> DataFrame:
    """The node table of (id, text) rows, each document parsed once."""
    own = F.struct(*_NAMES)
    held = F.transform(F.map_entries("attrs"), lambda e, i: F.struct(*[c.alias(k) for k, c in _attribute(e, i).items()]))
    rows = F.when(F.col("attrs").isNull(), F.array(own)).otherwise(F.concat(F.array(own), held))
    return trees(docs, id_col, text_col, html, recover, strip).select(F.explode(rows).alias("n")).select("n.*")


def document_facts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "xml") -> DataFrame:
    """One row per document: declaration, well-formedness, and the error with its place (permissive mode)."""

    def run(batches):
        for batch in batches:
            rows = []
            tree, names = _Tree(), _Names()
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                rows.append([doc_id.as_py(), *_xml_into(tree, names, doc_id.as_py(), text.as_py() or "").values()])
                tree.drop()
            yield _batch(rows, DOCS)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(run, DOCS)


EVENTS = "doc_id long, seq long, event string, name string, value string"


def events(nodes: DataFrame) -> DataFrame:
    """Forward event rows of a node table: starts and ends of documents and elements, attributes, characters, comments, instructions. ``seq`` orders them."""
    starts = F.when(F.col("kind") == DOC, "startDocument").when(F.col("kind") == ELEM, "startElement").when(F.col("kind") == ATTR, "attribute")
    starts = starts.when(F.col("kind") == TEXT, "characters").when(F.col("kind") == COMMENT, "comment").otherwise("processingInstruction")
    # an end follows everything at or below it; of several ends at one place the deepest comes first
    start = F.struct((F.col("pre") * 2).alias("at"), F.lit(0).alias("depth"), starts.alias("event"))
    end = F.struct(((F.col("pre") + F.col("size")) * 2 + 1).alias("at"), (-F.col("level")).alias("depth"), F.when(F.col("kind") == DOC, "endDocument").otherwise("endElement").alias("event"))
    both = F.when(F.col("kind").isin(DOC, ELEM), F.array(start, end)).otherwise(F.array(start))
    from pyspark.sql import Window

    rows = nodes.select("doc_id", "local", "value", F.explode(both).alias("e"))
    seq = F.row_number().over(Window.partitionBy("doc_id").orderBy("e.at", "e.depth"))
    return rows.select("doc_id", seq.cast("long").alias("seq"), "e.event", F.col("local").alias("name"), "value")


def detect_encoding(data: bytes) -> str:
    """Encoding of a document by byte-order mark, then first bytes, then declaration; UTF-8 else."""
    for mark, name in ((b"\x00\x00\xfe\xff", "utf-32-be"), (b"\xff\xfe\x00\x00", "utf-32-le"), (b"\xef\xbb\xbf", "utf-8-sig"), (b"\xfe\xff", "utf-16-be"), (b"\xff\xfe", "utf-16-le")):
        if data.startswith(mark):
            return name
    for head, name in ((b"\x00\x00\x00<", "utf-32-be"), (b"<\x00\x00\x00", "utf-32-le"), (b"\x00<\x00?", "utf-16-be"), (b"<\x00?\x00", "utf-16-le"), (b"\x4c\x6f\xa7\x94", "cp037")):
        if data.startswith(head):
            return name
    m = re.match(rb"<\?xml[^>]*?encoding\s*=\s*[\"']([A-Za-z0-9._-]+)[\"']", data)
    return m[1].decode("ascii").lower() if m else "utf-8"
