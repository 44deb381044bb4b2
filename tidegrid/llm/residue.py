"""Template residue, filler, error pages and script notices in place of an article's own content.

A text is cut into passages: title, authors, abstract, each section's body, and what lies outside of them (the whole text
where it has no structure). Comments, listings and quoted speech are taken out first, as are formulas, floats, citations and
includes; a passage of which nothing remains is no evidence. A passage is a set of features: words (pairs of ideographs),
commands, the shape ``@place`` of a template place, and how much its words repeat.

The classifier is a positive-unlabelled naive Bayes. Trusted records (passages that are nothing but a template place, or hold
an unmistakable error, script or filler phrase) are positive, all others unlabelled; expectation-maximization lets each
passage's posterior weigh the word counts of both classes until words that only ever keep company with trusted residue have
become evidence themselves. It is fitted on every passage of every document: features are hashed to ``BUCKETS`` numbers and
written once, a round computes posteriors and sums the positive counts where the passages lie, and the driver holds nothing
but one count and one weight per bucket, a fixed size at any scale. The same table is then scored. A record is excluded if
any passage's posterior of residue is over one half.

Defined results: NULL, empty and blank texts have no passage and are no case; a passage of any length is scored whole;
copies are judged alike; an empty table gives no row; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.session import written

_LISTING = re.compile(r"\\begin\{(verbatim\*?|lstlisting|comment|Verbatim|minted)\}.*?(?:\\end\{\1\}|\Z)", re.S)
_VERB = re.compile(r"\\verb\*?([^\w\s*]).*?\1")
_COMMENT = re.compile(r"(?<!\\)%[^\n]*")
_QUOTED = re.compile(r"``.{0,600}?''|“.{0,600}?”|„.{0,600}?“|«.{0,600}?»", re.S)
_DEFINED = re.compile(r"\\(?:re)?newcommand\*?\{?\\\w+\}?(?:\[\d\])?\{(?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*\}|\\def\\\w+[^\n]*")
_TITLE = re.compile(r"\\title\{(.*?)\}[ \t]*(?:\n|\Z)", re.S)
_AUTHOR = re.compile(r"\\author\{(.*?)\}[ \t]*(?:\n|\Z)", re.S)
_ABSTRACT = re.compile(r"\\begin\{abstract\}(.*?)(?:\\end\{abstract\}|(?=\\section)|\Z)", re.S)
_HEADING = re.compile(r"\\(?:sub){0,2}section\*?\{")
_END = re.compile(r"\\begin\{thebibliography\}|\\end\{document\}|\\bibliography\{")
_ITALIC = re.compile(r"\\textit\{([^{}]*|.*?)\}[ \t]*(?:\n|\Z)")
_FLOAT = re.compile(r"\\begin\{(equation\*?|align\*?|figure\*?|table\*?|tabular\*?|eqnarray\*?|gather\*?)\}.*?(?:\\end\{\1\}|\Z)", re.S)
_POINTER = re.compile(r"\\(?:cite\w*|ref|eqref|label|input|include|includegraphics|usepackage|documentclass|thanks|bibliographystyle)\s*(?:\[[^\]]*\])?\{[^{}]*(?:\}|\Z)|\\(?:begin|end)\{\w+\*?\}|\\maketitle|\\(?:and|newpage|noindent|par)\b")
_MATH = re.compile(r"\$\$.*?\$\$|\$[^$]*\$|\\\[.*?\\\]|\\\(.*?\\\)", re.S)

# The shapes of template places, and phrases that make a passage a trusted residue record.
DOLLAR_PLACES = (r"\$\{[^{}\n]{1,60}\}", r"\$\$[^\W\d][\w.]{1,60}\$\$")
PLACES = (
    r"\{\{+ ?[^\W\d][\w .]{0,60} ?\}\}+", r"<<[\w .]{1,60}>>", r"<\?=?.{1,60}?\?>", r"<%=?.{1,60}?%>", r"<!--.{1,60}?-->", r"\[\[[^\[\]\n]{1,60}\]\]",
    r"\[@[^\[\]\n]{1,60}\]", r"\[(?:INSERT|TO BE ADDED|Your|YOUR)\b[^\[\]\n]{0,60}\]", r"\[[^\[\]\n]{1,60} goes here\]", r"@@[\w.]{1,60}@@", r"__[\w.]{1,60}?__", r"#\{[^{}\n]{1,60}\}",
    r"&[A-Za-z][\w.]{1,60};", r"\|[^\W\d][\w.]{2,60}\|", r"\?\?\?[\w.]{1,60}\?\?\?", r"\bXXX .{1,60}? XXX\b", r"\\VAR\{[^{}\n]{1,60}\}", r"<[A-Za-z_][\w.]{2,60}>",
)
TRUSTED = (
    r"lorem ipsum", r"\basdf", r"dummy text", r"\\(?:blindtext|lipsum|blinddocument)\b", r"\b(?:error|http|fehler|erreur) ?40[34]\b", r"40[34] (?:not found|forbidden)", r"50[234] (?:service|bad|gateway)",
    r"(?:enable|activate|activar|active|activer|aktivieren|requires?|needs?|benötigt|nécessite|requiere|需要|启用)\s.{0,30}javascript", r"javascript and cookies are required",
    r"! latex error", r"! undefined control sequence", r"no pages of output", r"\byour (?:title|abstract|text|name|keywords) here", r"\btemplate\b.{0,60}\b(?:delete|replace|instructions)",
    r"\btitle of (?:the|your) (?:paper|article)\b", r"\b(?:insert title|untitled)\b", r"\btitel der arbeit\b", r"\btítulo del artículo\b", r"\btitre de l'article\b", r"(?:论文|文章)标题", r"\bpaper title\b", r"\bfirst author\b", r"\bauthor one\b", r"\bname surname\b", r"\bvorname\b", r"\bprénom\b", r"\bnombre (?:y )?apellido", r"作者姓名", r"\btext of the (?:section|introduction)\b", r"\bbody of the section goes\b",
)
# Plain lower-case strings of which every TRUSTED phrase holds one.
TRUSTED_HINTS = (
    "lorem ipsum", "asdf", "dummy text", "\\blindtext", "\\lipsum", "\\blinddocument", *(f"{w}{gap}40{d}" for w in ("error", "http", "fehler", "erreur") for gap in ("", " ") for d in (3, 4)),
    *(f"40{d} {w}" for d in (3, 4) for w in ("not found", "forbidden")), *(f"50{d} {w}" for d in (2, 3, 4) for w in ("service", "bad", "gateway")), "javascript", "! latex error", "! undefined control sequence", "no pages of output",
    *(f"your {w} here" for w in ("title", "abstract", "text", "name", "keywords")), "template", "title of the paper", "title of the article", "title of your paper", "title of your article", "insert title", "untitled",
    "titel der arbeit", "título del artículo", "titre de l'article", "论文标题", "文章标题", "paper title", "first author", "author one", "name surname", "vorname", "prénom", "nombre apellido", "nombre y apellido", "作者姓名",
    "text of the section", "text of the introduction", "body of the section goes",
)
_DOLLAR_PLACE = re.compile("|".join(DOLLAR_PLACES))
_PLACE = re.compile("|".join(PLACES))
_PLACE_HINT = re.compile(r"\{\{|[<\[@#&|]|__|\?\?|XXX|VAR")
_TRUST = re.compile("|".join(TRUSTED), re.S)
_PROSE = re.compile(r"\\(?:cite|ref|input|include|begin\{(?:equation|figure|table))")
_INITIAL = re.compile(r"\s*[A-Z]\.\s+\w")
_WORD = re.compile(r"@place|\\[a-z]+|[^\W\d_\u3400-\u9fff]+|[\u3400-\u9fff]+")

#: Longest passage that a trusted phrase alone makes a trusted record: residue pages are short.
TRUSTED_LENGTH = 1500


def passages(text: str) -> list[tuple[str, str]]:
    """(kind, passage) of a text, quotes, comments and listings taken out."""
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    if "\\begin{" in text:
        text = _LISTING.sub(" ", text)
    if "\\verb" in text:
        text = _VERB.sub(" ", text)
    if "%" in text:
        text = _COMMENT.sub("", text)
    if "``" in text or "“" in text or "«" in text:
        text = _QUOTED.sub(" ", text)
    if "newcommand" in text or "\\def" in text:
        text = _DEFINED.sub(" ", text)
    out: list[tuple[str, str]] = []

    def take(kind: str, pattern: re.Pattern, s: str) -> str:
        if not (found := pattern.search(s)):
            return s
        out.append((kind, found[1]))
        return s[: found.start()] + "\n" + s[found.end() :]

    text = take("title", _TITLE, text) if "\\title{" in text else text
    text = take("author", _AUTHOR, text) if "\\author{" in text else text
    heads = list(_HEADING.finditer(text))
    cut = [len(text)] if not heads else [h.start() for h in heads] + [len(text)]
    rest = text[: cut[0]]
    rest = take("abstract", _ABSTRACT, rest) if "\\begin{abstract}" in rest else rest
    if end := _END.search(rest):
        rest = rest[: end.start()]
    out.append(("rest", rest))
    for i, h in enumerate(heads):
        part = text[h.end() : cut[i + 1]]
        line = part.find("\n")
        line = len(part) if line < 0 else line
        close = part.rfind("}", 0, line)
        label = part.find("}\\label{", 0, line)
        close = label if label >= 0 else close if close >= 0 else line
        body = part[close + 1 :]
        if i == 0 and "\\begin{abstract}" in body:  # a preamble without commands: heading, names in italics, abstract
            out.append(("title", part[:close]))
            body = take("abstract", _ABSTRACT, body)
            body = take("author", _ITALIC, body)
        if end := _END.search(body):
            body = body[: end.start()]
        out.append(("body", body))
    return out


def features(passage: str, kind: str) -> set[str] | None:
    """The features of a passage; None if nothing of it remains."""
    s = passage
    if "\\" in s:
        s = _POINTER.sub(" ", _FLOAT.sub(" ", s) if "\\begin{" in s else s)
    if "$" in s:
        if "${" in s or "$$" in s:
            s = _DOLLAR_PLACE.sub(" @place ", s)
        s = _MATH.sub(" ", s)
    elif "\\[" in s or "\\(" in s:
        s = _MATH.sub(" ", s)
    if _PLACE_HINT.search(s):
        s = _PLACE.sub(" @place ", s)
    words = _WORD.findall(s.lower())
    seen = set(words)
    if not seen:
        return None
    if len(words) >= 8:
        seen.add(f"@r{10 * len(seen) // len(words)}")
    if not s.isascii():
        for w in [w for w in seen if "\u3400" <= w[0] <= "\u9fff"]:
            seen.discard(w)
            seen.update(w[i : i + 2] for i in range(max(len(w) - 1, 1)))
    if kind == "rest":
        seen.add("@rest")
    elif kind == "author" and _INITIAL.match(s):
        seen.add("@initial")
    return seen


def is_trusted(passage: str, seen: set[str]) -> bool:
    """Nothing but template places, or short, with an unmistakable phrase and nothing that points into an article."""
    if seen <= {"@place", "@rest"}:
        return True
    if len(passage) > TRUSTED_LENGTH:
        return False
    low = passage.lower()
    # the plain strings only spare the patterns: without one no pattern fits
    return any(h in low for h in TRUSTED_HINTS) and not _PROSE.search(passage) and _TRUST.search(low) is not None


#: Numbers that features are hashed to: bounds the model, what is broadcast (4 bytes each) and what the driver collects.
BUCKETS = 1 << 22
_KNOWN: dict[str, int] = {}


def bucket_of(feature: str) -> int:
    """The feature's number; a worker remembers what it has hashed, up to a million features."""
    if (b := _KNOWN.get(feature)) is None:
        if len(_KNOWN) >= 1 << 20:
            _KNOWN.clear()
        b = _KNOWN[feature] = zlib.crc32(feature.encode("utf-8", "surrogatepass")) % BUCKETS
    return b


_TABLE = "kinds array<string>, trusted array<boolean>, features array<array<int>>"


def feature_table(df: DataFrame, id_column: str, text: str) -> DataFrame:
    """A row per document with a passage: id, and for each passage its kind, whether it is trusted, its hashed features."""
    source = df.select(df[id_column].alias("id"), df[text].alias("text")).where("text is not null")
    fields = T.StructType([T.StructField("id", source.schema["id"].dataType), *T._parse_datatype_string(_TABLE)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, kinds, trusted, rows, sizes, flat = [], [], [], [0], [0], []
            for i, x in enumerate(b["text"]):
                for kind, s in passages(x.as_py()):
                    if seen := features(s, kind):
                        kinds.append(kind)
                        trusted.append(is_trusted(s, seen))
                        flat.extend(map(bucket_of, seen))
                        sizes.append(len(flat))
                if len(kinds) > rows[-1]:
                    keep.append(i)
                    rows.append(len(kinds))
            at = pa.array(rows, pa.int32())
            lists = [pa.ListArray.from_arrays(at, v) for v in (pa.array(kinds, pa.string()), pa.array(trusted, pa.bool_()), pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(flat, pa.int32())))]
            yield pa.RecordBatch.from_arrays([b["id"].take(pa.array(keep, pa.int64())), *lists], names=["id", "kinds", "trusted", "features"])

    return source.mapInArrow(run, fields)


@dataclass(frozen=True)
class ResidueModel:
    """Log-odds of residue per bucket, and the prior's."""

    weight: np.ndarray
    prior: float

    def scores(self, flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The score of each passage; ``starts``: where its features begin in ``flat``. No passage is empty."""
        return self.prior + np.add.reduceat(self.weight[flat].astype(np.float64), starts) if len(starts) else np.zeros(0)

    def score(self, seen: set[str]) -> float:
        return float(self.scores(np.array([bucket_of(w) for w in seen]), np.array([0]))[0])


def _columns(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Passages per document, trusted, starts and features of a batch of the table."""
    per_doc = np.asarray(b["kinds"].value_lengths())
    lists = b["features"].flatten()
    sizes = np.asarray(lists.value_lengths())
    return per_doc, np.asarray(b["trusted"].flatten()), np.cumsum(sizes) - sizes, np.asarray(lists.flatten())


def _counted(table: DataFrame, model: ResidueModel | None) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
    """Positive count per bucket; without a model also all passages per bucket; and positive mass and number of passages."""
    spark = table.sparkSession
    shared = spark.sparkContext.broadcast(model)  # BUCKETS weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        pos, everything, mass, n = np.zeros(BUCKETS), np.zeros(BUCKETS, np.int32) if m is None else None, 0.0, 0
        for b in batches:
            _, trusted, starts, flat = _columns(b)
            q = trusted.astype(np.float64)
            if m is None:
                everything += np.bincount(flat, minlength=BUCKETS).astype(np.int32)
            else:
                q = np.where(trusted, 1.0, 1 / (1 + np.exp(-np.clip(m.scores(flat, starts), -30, 30))))
            q[q <= 1e-6] = 0
            mass, n = mass + q.sum(), n + len(q)
            per = np.repeat(q, np.diff(np.r_[starts, len(flat)]))
            use = per > 0
            np.add.at(pos, flat[use], per[use])
        have = np.flatnonzero(pos if everything is None else everything)
        count = np.zeros(len(have), np.int64) if everything is None else everything[have].astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[have, -1]), pa.array(np.r_[pos[have], mass]), pa.array(np.r_[count, n])], names=["bucket", "pos", "n"])

    got = table.select("kinds", "trusted", "features").mapInArrow(run, "bucket bigint, pos double, n bigint").groupBy("bucket").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n")).toArrow()
    shared.destroy()
    bucket, p, n = (np.asarray(got[c]) for c in ("bucket", "pos", "n"))
    head = bucket < 0
    pos, total = np.zeros(BUCKETS), np.zeros(BUCKETS)
    pos[bucket[~head]], total[bucket[~head]] = p[~head], n[~head]
    return pos, total if model is None else None, np.array([p[head].sum(), n[head].sum()])


def fit(table: DataFrame, rounds: int = 8, smooth: float = 0.5) -> ResidueModel:
    """Expectation-maximization over all passages of the table (written before), the trusted ones kept positive. A bucket
    that one passage only holds is no evidence."""
    pos, total, (mass, n) = _counted(table, None)
    known, model = total >= 2, None
    for k in range(rounds):
        if k:
            pos, _, (mass, n) = _counted(table, model)
        rest = np.maximum(total - pos, 0)
        weight = np.log((pos + smooth * 0.02) / (mass + smooth)) - np.log((rest + smooth) / (n - mass + smooth))
        model = ResidueModel(np.where(known, weight, 0).astype(np.float32), float(np.log((mass + 1) / (n - mass + 1))))
    return model


def scored(table: DataFrame, model: ResidueModel, evidence: bool = False) -> DataFrame:
    """Documents to exclude: id (and with ``evidence`` the passages' kinds and the largest score). One pass, no shuffle."""
    shared = table.sparkSession.sparkContext.broadcast(model)  # BUCKETS weights
    fields = T.StructType([T.StructField("id", table.schema["id"].dataType), T.StructField("kinds", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            per_doc, _, starts, flat = _columns(b)
            score = shared.value.scores(flat, starts)
            first = np.cumsum(per_doc) - per_doc
            best = np.maximum.reduceat(score, first) if len(first) else np.zeros(0)
            hit = np.flatnonzero(best > 0)
            names = b["kinds"].take(pa.array(hit)).to_pylist()
            kinds = [",".join(sorted({k for k, s in zip(ks, score[first[i] :], strict=False) if s > 0})) for i, ks in zip(hit, names, strict=True)]
            yield pa.RecordBatch.from_arrays([b["id"].take(pa.array(hit)), pa.array(kinds, pa.string()), pa.array(best[hit])], names=["id", "kinds", "score"])

    out = table.mapInArrow(run, fields)
    return out if evidence else out.select("id")


def excluded(df: DataFrame, id_column: str, text: str, evidence: bool = False) -> DataFrame:
    """Fit on all of ``df`` and score all of it: the documents with residue in place of their own content."""
    table = written(feature_table(df, id_column, text), "passages")
    return scored(table, fit(table), evidence)
