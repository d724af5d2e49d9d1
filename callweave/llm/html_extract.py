"""HTML extraction by a site style tree (after Yi, Liu and Li, 2003).

The DOM trees of one host are merged: an element's children, with runs of one tag folded, form a presentation style, and elements at the same place
under the same style are one node of the merged tree. A node is important when its pages present it in many ways, and a text node when its pages'
texts differ: both by entropy to the base of the number of pages. Importance is combined upwards. A node is noisy when its own composite importance and that of
all below it (but for elements without content, such as br) are under ``threshold``; from each page the highest noisy branches are cut off. What
remains is the text.

Scale: pages are parsed twice. Between the passes only node statistics are shuffled, summed by (host, node), so that the largest host is not one task; per host
there is one small merged tree, without texts. The list of noisy nodes goes to all tasks if it is at most ``broadcast_rows`` long; otherwise pages meet it by host and salt, so
that a hot host is spread over SALTS tasks. A host's merged tree is put together in one task: the nodes that two pages at least share, with their styles' counts.
"""

from __future__ import annotations

import html as entities
import math
import re

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callweave.llm._frames import checkpointed, quoted, with_fields
from callweave.session import importable

THRESHOLD = 0.7
GAMMA = 0.9
BROADCAST_ROWS = 100_000
SALTS = 32

_RAW = frozenset("script style noscript template textarea iframe".split())
_LETTER = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
_NAME = re.compile(r"[^\s>/]+")
_STOP = re.compile(r"[>\"']")
_NAMED = re.compile(r"(?:^|\s)(class|id)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr b bdi bdo cite code em font i img kbd mark q s samp small span strong sub sup time tt u var wbr".split())
#: An opening tag ends an open element of these tags, up to the nearest container.
_ENDS = {"li": {"li"}, "p": {"p"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_BLOCKS_END_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_SPACE = re.compile(r"\s+")

TEXT = "#text"


class Node:
    __slots__ = ("tag", "children", "text")

    def __init__(self, tag: str, text: str = ""):
        self.tag, self.text, self.children = tag, text, []


def tags(source: str):
    """(begin, end, kind, name, rest) of all markup, in order. Kinds: "open" and "raw" with a lower-case name and attributes, "close" with a name, "cdata" with its text, "" for what is dropped.

    One pass, in time linear in the page whatever it holds: the end of a quote, comment or raw element that has none is looked for once. An
    unclosed quote is an ordinary character, an unclosed tag, comment or raw element runs to the page's end.
    """
    n, at = len(source), 0
    gone: dict[str, bool] = {}  # ends that do not occur after `at`
    lower = source.lower() if source.isascii() else re.sub("[A-Z]+", lambda m: m[0].lower(), source)

    def ending(mark: str, begin: int, where: str = source) -> int:
        """Where ``mark`` stands at ``begin`` or later, or -1."""
        if gone.get(mark):
            return -1
        found = where.find(mark, begin)
        gone[mark] = found < 0
        return found

    def tag_end(begin: int) -> int:
        """Place of the ">" that ends a tag's attributes, or the page's end."""
        while (m := _STOP.search(source, begin)) is not None:
            if m[0] == ">":
                return m.start()
            close = ending(m[0], m.end())
            begin = m.end() if close < 0 else close + 1
        return n

    while (begin := source.find("<", at)) >= 0:
        at = begin + 1
        after = source[at : at + 1]
        if after == "!" or after == "?":
            if source.startswith("!--", at):
                end = ending("-->", at + 3)
                at = n if end < 0 else end + 3
                yield begin, at, "", "", ""
            elif source.startswith("![CDATA[", at):
                end = ending("]]>", at + 8)
                yield begin, n if end < 0 else end + 3, "cdata", "", source[at + 8 : n if end < 0 else end]
                at = n if end < 0 else end + 3
            else:
                end = ending(">", at)
                at = n if end < 0 else end + 1
                yield begin, at, "", "", ""
        elif after == "/" and source[at + 1 : at + 2] in _LETTER:
            name = _NAME.match(source, at + 1)
            end = ending(">", name.end())
            at = n if end < 0 else end + 1
            yield begin, at, "close", name[0].lower(), ""
        elif after in _LETTER:
            name = _NAME.match(source, at)
            end = tag_end(name.end())
            tag, rest = name[0].lower(), source[name.end() : end]
            at = min(n, end + 1)
            if tag in _RAW:
                while (close := ending(f"</{tag}", at, lower)) >= 0:
                    at = close + len(tag) + 2
                    if not source[at : at + 1].isalnum():
                        break
                end = ending(">", at) if close >= 0 else -1
                at = n if end < 0 else end + 1
                yield begin, at, "raw", tag, rest
            else:
                yield begin, at, "open", tag, rest


def parse(source: str) -> Node:
    """The DOM of a page. Comments, scripts, styles and declarations are dropped; unclosed and stray tags are tolerated; never recursive.

    A closing tag is looked for among the open elements only if one of its name is open, and what it passes is closed, so that the work is linear.
    """
    root = Node("#root")
    stack, names = [root], ["#root"]
    still: dict[str, int] = {}
    at = 0

    def text(raw: str, plain: bool = False) -> None:
        words = _SPACE.sub(" ", raw if plain else entities.unescape(raw))
        if words.strip():
            stack[-1].children.append(Node(TEXT, words))
        elif words and stack[-1].children and stack[-1].children[-1].tag == TEXT:
            stack[-1].children[-1].text += " "

    def close(k: int) -> None:
        for name in names[k:]:
            still[name] -= 1
        del stack[k:], names[k:]

    for begin, end, kind, tag, rest in tags(source):
        if begin > at:
            text(source[at:begin])
        at = end
        if kind == "cdata":
            text(rest, plain=True)
        elif kind == "close":
            if still.get(tag):
                close(next(k for k in range(len(names) - 1, 0, -1) if names[k] == tag))
        elif kind == "open":
            ends = _ENDS.get(tag, set()) | ({"p"} if tag in _BLOCKS_END_P else set())
            while ends and len(stack) > 1 and (names[-1] in ends or names[-1] in _INLINE and any(n in ends for n in names[-4:-1])):
                close(len(stack) - 1)
            labels = "".join(f".{(a[1] or a[2] or a[3]).strip().lower()}" for a in _NAMED.findall(rest)) if "=" in rest else ""
            node = Node(tag + labels)
            stack[-1].children.append(node)
            if tag not in _VOID and not rest.endswith("/"):
                stack.append(node)
                names.append(tag)
                still[tag] = still.get(tag, 0) + 1
    if at < len(source):
        text(source[at:])
    return root


def style_of(node: Node) -> tuple[str, list[int]]:
    """The children's tags with runs folded, and for each child its place in that sequence."""
    tags, places = [], []
    for child in node.children:
        if not tags or tags[-1] != child.tag:
            tags.append(child.tag)
        places.append(len(tags) - 1)
    return " ".join(tags), places


def _hash(*parts) -> int:
    return xxhash.xxh64_intdigest("\x00".join(map(str, parts))) - (1 << 63)


ROOT_KEY = _hash("root")
NO_CHILDREN = _hash("")


def walk(root: Node):
    """(node, its key in the merged tree, parent's key, hash of the parent's style, depth, own style, children's places), parents first."""
    stack = [(root, ROOT_KEY, None, None, 0)]
    while stack:
        node, key, parent, parent_style, depth = stack.pop()
        style, places = style_of(node)
        yield node, key, parent, parent_style, depth, style, places
        if node.children:
            sig = _hash(style)
            keys: dict[int, int] = {}
            for child, place in zip(reversed(node.children), reversed(places)):
                if place not in keys:
                    keys[place] = _hash(key, sig, place, child.tag)
                stack.append((child, keys[place], key, sig, depth + 1))


def page_statistics(root: Node) -> dict:
    """(key, kind, sig) -> [parent, parent style, depth, count]; kinds: 0 the page has the node, 1 a style of an element, 2 a text."""
    out: dict = {}
    for node, key, parent, parent_style, depth, style, _ in walk(root):
        out[(key, 0, 0)] = [parent, parent_style, depth, 1]
        entry = (key, 2, _hash(node.text.strip())) if node.tag == TEXT else (key, 1, _hash(style))
        if entry in out:
            out[entry][3] += 1
        else:
            out[entry] = [parent, parent_style, depth, 1]
    return out


def extracted(root: Node, noisy: frozenset) -> tuple[str, int, int]:
    """The text without noisy branches, how many branches were cut, and how many characters of text stayed. Blocks start new lines."""
    pieces: list[str] = []
    cut = 0
    stack: list = [(root, ROOT_KEY)]
    while stack:
        item = stack.pop()
        if isinstance(item, str):
            pieces.append(item)
            continue
        node, key = item
        if key in noisy:
            cut += 1
            continue
        if node.tag == TEXT:
            pieces.append(node.text)
            continue
        block = node.tag.split(".", 1)[0] not in _INLINE
        if block:
            pieces.append("\n")
            stack.append("\n")
        style, places = style_of(node)
        sig = _hash(style)
        keys: dict[int, int] = {}
        for child, place in zip(reversed(node.children), reversed(places)):
            if place not in keys:
                keys[place] = _hash(key, sig, place, child.tag)
            stack.append((child, keys[place]))
    lines = (_SPACE.sub(" ", line).strip() for line in "".join(pieces).split("\n"))
    text = "\n".join(line for line in lines if line)
    return text, cut, len(text)


def composite(nodes: pd.DataFrame, styles: pd.DataFrame, gamma: float, threshold: float) -> list[int]:
    """Keys of the noisy nodes of one host; the root, of depth 0, is none. ``styles``: key, sig, p.

    ``nodes``: key, parent, parent_style, depth, importance, n_styles, empty, singles. A row with ``singles`` stands for so many nodes below one style, which one page alone
    has: their importance is 1, and nothing below them counts.
    """
    share = {(k, s): p for k, s, p in zip(styles["key"], styles["sig"], styles["p"])}
    below: dict[int, dict[int, list[tuple[float, int]]]] = {}
    holds: set[int] = set()  # nodes with something of importance below them
    noisy = []
    for r in nodes.sort_values(["depth", "key"], ascending=[False, True]).itertuples(index=False):
        value, n = r.importance, max(1, r.singles)
        if r.n_styles > 0:
            weight = gamma**r.n_styles
            inner = math.fsum(share.get((r.key, sig), 0.0) * math.fsum(x for x, _ in v) / sum(k for _, k in v) for sig, v in sorted(below.pop(r.key, {}).items()))
            value = (1 - weight) * value + weight * inner
        if r.depth > 0:
            below.setdefault(r.parent, {}).setdefault(r.parent_style, []).append((value * n, n))
            if value < threshold and r.key not in holds:
                noisy.append(r.key)
            elif not r.empty:
                holds.add(r.parent)
    return noisy


def noisy_nodes(pages: DataFrame, threshold: float = THRESHOLD, gamma: float = GAMMA) -> DataFrame:
    """(host, noisy: keys) of every host with at least two pages. ``pages`` has columns host and html."""

    def count(batches):
        for batch in batches:
            rows: dict = {}
            for host, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if host and source:
                    for (key, kind, sig), (parent, style, depth, n) in page_statistics(parse(source)).items():
                        have = rows.setdefault((host, key, kind, sig), [parent, style, depth, 0, 0.0])
                        have[3] += n
                        have[4] += n * math.log(n)
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.float64())
            columns = list(zip(*[(*k, *v) for k, v in rows.items()])) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=list("abcdefghi"))

    schema = "host string, key long, kind int, sig long, parent long, parent_style long, depth int, n long, nlogn double"
    counted = pages.select("host", "html").mapInArrow(count, schema)
    sums = counted.groupBy("host", "key", "kind", "sig", "parent", "parent_style", "depth").agg(F.sum("n").alias("n"), F.sum("nlogn").alias("nlogn"))
    # Over pages, a text with n occurrences, n_i of them on page i, has entropy ln n - (sum n_i ln n_i) / n.
    scattered = F.when(F.col("kind") == 2, F.log("n") - F.col("nlogn") / F.col("n"))
    shown = F.when(F.col("kind") == 1, F.col("n"))
    nodes = sums.groupBy("host", "key", "parent", "parent_style", "depth").agg(
        F.sum(F.when(F.col("kind") == 0, F.col("n"))).alias("m"),
        F.avg(scattered).alias("text_entropy"),
        F.sum(shown).alias("shown"),
        F.sum(shown * F.log(shown)).alias("shown_log"),
        F.count(shown).alias("n_styles"),
        F.collect_list(F.when((F.col("kind") == 1), F.struct("sig", "n"))).alias("styles"),
    )
    presented = F.log("shown") - F.col("shown_log") / F.col("shown")
    importance = F.when(F.col("m") < 2, 1.0).otherwise(
        F.when(F.col("text_entropy").isNotNull(), 1 - F.col("text_entropy") / F.log("m")).otherwise(presented / F.log("m"))
    )
    # The root's null parent gets a number: with a null, pandas has the whole column as floats, which are too short for keys.
    above = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("parent", "parent_style")]
    # A style that has no children says nothing about importance below it: such elements (br, img) are leaves of importance 1.
    leaf = (F.col("n_styles") > 0) & F.forall("styles", lambda s: s["sig"] == NO_CHILDREN)
    value = F.when(leaf, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), importance)))
    n_styles = F.when(leaf, 0).otherwise(F.col("n_styles")).cast("long")
    every = nodes.where("host is not null").select("host", "key", *above, "depth", value.alias("importance"), n_styles.alias("n_styles"), "shown", "styles", "m", leaf.alias("empty"))
    every = checkpointed(every.withColumns({"shown": F.coalesce("shown", F.lit(0).cast("long")), "singles": F.lit(0).cast("long")}))  # read three times, parsed once
    # Nodes of one page alone have importance 1, as all below them: those under a shared node are counted, the rest left out, so that a host's tree has what its pages share.
    shared = every.where("m > 1")
    alone = every.where("m < 2 and depth > 0").groupBy("host", "parent", "parent_style", "depth").agg(F.count("*").alias("singles"), F.min("empty").alias("empty"))
    alone = alone.join(shared.select("host", F.col("key").alias("parent")), ["host", "parent"], "left_semi")
    zero = F.lit(0).cast("long")
    alone = alone.select("host", zero.alias("key"), "parent", "parent_style", "depth", F.lit(1.0).alias("importance"), zero.alias("n_styles"), zero.alias("shown"), F.array().cast(shared.schema["styles"].dataType).alias("styles"), F.lit(1).cast("long").alias("m"), "empty", "singles")
    tree = shared.unionByName(alone)

    def combine(key, pdf):
        flat = [(k, s["sig"], s["n"] / shown) for k, shown, ss in zip(pdf["key"], pdf["shown"], pdf["styles"]) for s in ss]
        noisy = composite(pdf.drop(columns=["styles", "shown", "m"]), pd.DataFrame(flat, columns=["key", "sig", "p"]), gamma, threshold)
        return pd.DataFrame({"host": [key[0]], "noisy": [noisy]})

    return tree.groupBy("host").applyInPandas(combine, "host string, noisy array<long>").where(F.size("noisy") > 0)


def html_extract(
    pages: DataFrame,
    threshold: float = THRESHOLD,
    gamma: float = GAMMA,
    broadcast_rows: int = BROADCAST_ROWS,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
) -> DataFrame:
    """(page_id, host, text, n_cut): the text of every page without its site's low-importance branches, and how many branches were cut.

    A page whose URL is null or has no host, and the only page of a host, is compared with nothing: its whole text stays. Null and empty
    HTML gives an empty text. Repeated rows are pages of their own (and so make their content look like a template). Nodes of exactly ``threshold`` stay.
    Rows with a null id are extracted too; ids may be of any type. Other columns, whatever their names, are never read. An empty table gives an empty table.
    """
    importable(pages.sparkSession)
    host = F.lower(F.regexp_extract(pages[quoted(url_col)].cast("string"), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1))
    read = pages.select(pages[quoted(id_col)].alias("page_id"), F.nullif(host, F.lit("")).alias("host"), pages[quoted(html_col)].alias("html"))
    noisy = checkpointed(noisy_nodes(read, threshold, gamma))
    size = noisy.agg(F.coalesce(F.sum(F.size("noisy")), F.lit(0))).first()[0]

    def extract(batches):
        sets: dict[str, frozenset] = {}
        for batch in batches:
            hosts, lists = batch.column(1).to_pylist(), batch.column(3)
            texts, cuts = [], []
            for i, (h, source) in enumerate(zip(hosts, batch.column(2).to_pylist())):
                if h not in sets:
                    sets[h] = frozenset(lists[i].as_py() or ()) if h else frozenset()
                text, cut, _ = extracted(parse(source), sets[h]) if source else ("", 0, 0)
                texts.append(text)
                cuts.append(cut)
            arrays = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(cuts, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["page_id", "host", "text", "n_cut"])

    if size <= broadcast_rows:
        joined = read.join(F.broadcast(noisy), "host", "left")
    else:
        spread = read.withColumn("salt", F.pmod(F.xxhash64("page_id", "html"), F.lit(SALTS)))
        salted = noisy.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        joined = spread.join(salted, ["host", "salt"], "left")
    out = with_fields(T.StructType([read.schema["page_id"]]), ("host", T.StringType()), ("text", T.StringType()), ("n_cut", T.LongType()))
    return joined.select("page_id", "host", "html", "noisy").mapInArrow(extract, out)
