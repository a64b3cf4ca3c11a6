"""Chunking of markdown, plain text and code. Each text is chunked by itself, in Arrow batches, without a shuffle."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: sizes in characters
MAX_CHARS, MIN_CHARS, OVERLAP, MIN_OVERLAP = 4000, 200, 300, 16
CHUNKS = T.ArrayType(T.StringType())
SYMBOLS = T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("start_line", T.IntegerType()), T.StructField("end_line", T.IntegerType()), T.StructField("parent", T.ArrayType(T.StringType())), T.StructField("doc", T.StringType()), T.StructField("calls", T.ArrayType(T.StringType())), T.StructField("text", T.StringType())]))
#: Bytes of text that a worker has in Python's strings at once; a longer text is taken by itself.
SLICE_BYTES = 2_000_000
HEADING = r"(?m)^#{1,2}\s"
_OPENING = re.compile(rf"{HEADING}")
_FRONT = re.compile(r"\A---\r?\n.*?\r?\n---\r?\n", re.S)
_BLANK = re.compile(r"\r?\n\s*\n")
_SENTENCES = re.compile(r".+?(?:[.!?](?=\s)|\Z)\s*", re.S)


def text_slices(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``SLICE_BYTES`` of the texts in ``column``, at least one row each."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        group = (np.cumsum(lengths) - lengths) // SLICE_BYTES
        bounds = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(bounds, bounds[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a)


def units(body: str, limit: int, headed: bool) -> Iterator[tuple[bool, str]]:
    """(opens, text): what chunks are made of, none beyond ``limit``. A unit is a whole section where that fits, else a
    paragraph, else a sentence, else a slice; it opens where a section does. A section starts at each H1 or H2 line."""
    at = [m.start() for m in _OPENING.finditer(body) if m.start()] if headed else []
    for start, end in zip([0, *at], [*at, len(body)], strict=True):
        section, opens = body[start:end].strip("\n"), True
        for paragraph in [section] if len(section) <= limit else _BLANK.split(section):
            for sentence in [paragraph] if len(paragraph) <= limit else (m[0].rstrip() for m in _SENTENCES.finditer(paragraph)):
                for k in range(0, len(sentence), limit):
                    if sentence.strip():
                        yield opens, sentence[k : k + limit]
                        opens = False


def paced(parts: Iterable[tuple[bool, str]], limit: int, least: int) -> list[str]:
    """Chunks of units in one pass. A new one is due where a section opens or a unit would pass the limit; it is put off,
    and the size counted anew, while fewer than ``least`` characters are held."""
    out: list[str] = []
    held, size = [], 0
    for opens, unit in parts:
        if held and (opens or size + 2 + len(unit) > limit):
            size = 0
            if len(whole := "\n\n".join(held).strip()) >= least:
                out.append(whole)
                held = []
        held.append(unit)
        size += len(unit) + (2 if size else 0)
    return [*out, last] if (last := "\n\n".join(held).strip()) else out


def led_in(chunks: Column, overlap: int) -> Column:
    """Each chunk without a heading after the end of the one before: from a sentence's start, else from a word's, at most
    ``overlap`` characters or half the chunk, at least MIN_OVERLAP."""
    trimmed = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")

    def tail(before: Column) -> Column:
        size = F.least(F.lit(overlap), F.floor(F.length(before) / 2)).cast("int")
        window = F.when(size >= MIN_OVERLAP, F.substring(before, F.length(before) - size + 1, size)).otherwise("")
        starts = [trimmed(F.regexp_extract(window, p, 1)) for p in (r"(?s)[.!?]\s+(.*)$", r"(?s)\s(.*)$")]
        return F.coalesce(*[F.when(F.length(t) >= MIN_OVERLAP, t) for t in starts])

    # the first chunk's predecessor is taken to be itself, and not used
    def led(c: Column, i: Column) -> Column:
        before = tail(F.element_at(chunks, F.greatest(i, F.lit(1))))
        return F.when((i > 0) & ~c.rlike(HEADING) & before.isNotNull(), F.concat(before, F.lit("\n\n"), c)).otherwise(c)

    return F.transform(chunks, led)


def chunked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kind: str = "markdown", limit: int = MAX_CHARS, least: int = MIN_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """(id, chunk_index, content). Markdown loses its frontmatter, is cut at headings and its continuations are led in; other
    text is cut by size alone. A chunk beyond twice the limit is sliced."""
    headed = kind == "markdown"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, 1):
            chunks = [paced(units(_FRONT.sub("", t or "") if headed else t or "", limit, headed), limit, least) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(chunks, pa.list_(pa.string()))], names=[id_col, "chunks"])

    rows = docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(cut, T.StructType([docs.schema[id_col], T.StructField("chunks", CHUNKS)]))
    if headed:
        led = led_in(F.col("chunks"), min(overlap, limit // 2))
        slices = F.transform(led, lambda c: F.when(F.length(c) > 2 * limit, F.regexp_extract_all(c, F.lit(f"(?s).{{1,{limit}}}"), 0)).otherwise(F.array(c)))
        rows = rows.withColumn("chunks", F.flatten(slices))
    return rows.select(id_col, F.posexplode("chunks").alias("chunk_index", "content"))


def fenced_code(text: Column, languages: tuple[str, ...] = ("python", "py", "typescript", "ts", "javascript", "js", "go", "rust", "java", "sql")) -> Column:
    """(language, code) of fenced blocks in known languages, at most 100."""
    pattern = r"(?ms)^```([A-Za-z]+)[^\n]*\n(.*?)^```\s*$"
    pairs = F.zip_with(F.regexp_extract_all(text, F.lit(pattern), 1), F.regexp_extract_all(text, F.lit(pattern), 2), lambda lang, code: F.struct(F.lower(lang).alias("language"), code.alias("code")))
    return F.slice(F.filter(pairs, lambda p: p["language"].isin(*languages)), 1, 100)


def _called(f: ast.expr) -> str:
    """The source of what is called; names with dots are put together here, which is much cheaper than unparsing."""
    names, at = [], f
    while isinstance(at, ast.Attribute):
        names.append(at.attr)
        at = at.value
    return ".".join([at.id, *reversed(names)]) if isinstance(at, ast.Name) else ast.unparse(f)


def python_symbols(source: str) -> list[tuple]:
    """Functions and classes of Python source by its syntax tree; none for source that does not parse."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        return []
    lines, out = source.splitlines(), []

    def visit(node: ast.AST, parents: list[str]) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                calls = sorted({_called(c.func) for c in ast.walk(child) if isinstance(c, ast.Call)})
                kind = "class" if isinstance(child, ast.ClassDef) else "method" if parents else "function"
                out.append((child.name, kind, child.lineno, child.end_lineno, parents, ast.get_docstring(child), calls, "\n".join(lines[child.lineno - 1 : child.end_lineno])))
                visit(child, [*parents, child.name])
            else:
                visit(child, parents)

    visit(tree, [])
    return out


def code_symbols(files: DataFrame, id_col: str = "path", text_col: str = "text") -> DataFrame:
    """(id, name, kind, start_line, end_line, parent, doc, calls, text) of Python files."""

    @F.pandas_udf(SYMBOLS)
    def symbols(text: pd.Series) -> pd.Series:
        names = SYMBOLS.elementType.names
        return text.map(lambda t: [dict(zip(names, s, strict=True)) for s in python_symbols(t or "")])

    return files.select(F.col(id_col), F.inline(symbols(F.col(text_col))))
