"""LaTeX projects: files on any store that Spark reads, one project a folder.

Files are read with Spark's own ``binaryFile`` source; a project (one folder's sources) is assembled by a grouped
Arrow function since includes nest. What rules need is kept as one row a project.
"""

from __future__ import annotations

import functools
import itertools
import unicodedata
from collections.abc import Callable, Collection, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import bibtex, latex, texscan
from ..functions.text import plain_title, utf8

PROJECT = "doc_id string, main string, expanded string, preamble string, body string, visible string, structural string, text string, headings array<struct<title:string,level:int,char_start:int>>, read array<string>, bib_paths array<string>, bib_declared boolean, error string, source_map array<struct<at:int,n:int,source:int,offset:int,m:int>>"
#: Further columns that ``projects`` makes where they are asked for: entries of the bibliography, of a repeated key the last one.
MORE = "bib array<struct<pos:int,key:string,entry_type:string,fields:map<string,string>>>"
#: Projects that a task holds read at a time.
PROJECTS_AT_ONCE = 64
BIB = "doc_id string, pos int, key string, entry_type string, fields map<string,string>"


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """Files of all projects under ``root``: ``doc_id`` (the folder), ``path`` inside it, ``sha256``, ``content``."""
    base = qualified(spark, root)
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base).where(F.startswith("path", F.lit(base + "/")))
    inside = F.substring("path", len(base) + 2, 2**31 - 1)
    return raw.select(F.regexp_extract(inside, "^([^/]+)/", 1).alias("doc_id"), F.regexp_replace(inside, "^[^/]+/", "").alias("path"), F.sha2("content", 256).alias("sha256"), "content").where("doc_id <> ''")


def qualified(spark: SparkSession, root: str) -> str:
    """``root`` as its file system names it, so that a relative one, or one whose name recurs further down, is a plain prefix of the paths read."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(path).toString().rstrip("/")


def faults(files: DataFrame) -> DataFrame:
    """``doc_id``, ``path`` and ``problem`` of the text files that cannot be read; they cost their own project's checks, never a run."""
    texts = files.where(F.col("path").rlike(r"(?i)\.(tex|bib|cls|sty|ya?ml)$"))
    return texts.where(utf8(F.col("content")).isNull()).select("doc_id", "path", F.lit("not UTF-8").alias("problem"))


def main_files(files: DataFrame) -> DataFrame:
    """The main source of each project: ``main.tex`` at the top, else the only nested one, else ``main.pdf``; ``problem`` says why there is none."""
    main = _main()
    return files.groupBy("doc_id").agg(*_seen()).select("doc_id", main.alias("main"), F.when(main.isNull(), F.when(F.size("n") > 1, "ambiguous").otherwise("not found")).alias("problem"))


def _seen() -> list[Column]:
    """What tells the main source of a project, over its files."""
    nested = F.collect_set(F.when(F.col("path").rlike(r"/main\.tex$"), F.col("path")))
    return [F.count_if(F.col("path") == "main.tex").alias("t"), nested.alias("n"), F.count_if(F.col("path") == "main.pdf").alias("p")]


def _main() -> Column:
    return F.when(F.col("t") > 0, "main.tex").when(F.size("n") == 1, F.get("n", F.lit(0))).when((F.size("n") == 0) & (F.col("p") > 0), "main.pdf")


def projects(files: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """A row of ``PROJECT`` for each project with a LaTeX main source; of ``columns`` alone (``PROJECT``'s or ``MORE``'s) if they are named.

    Files are grouped once. Reading them takes far longer than their bytes tell, so projects are dealt to a fixed number of tasks: adaptive
    execution would put whatever compresses well into a few.
    """
    kinds_ = dict(c.split(" ", 1) for c in f"{PROJECT}, {MORE}".split(", "))
    asked = columns or [c.split(" ", 1)[0] for c in PROJECT.split(", ")]
    types = {c: _ARROW.get(c, pa.string()) for c in asked}
    text = F.when(F.col("path").rlike(r"(?i)\.(tex|bib)$"), F.struct("path", "content"))
    whole = spread(files).groupBy("doc_id").agg(*_seen(), F.collect_list(text).alias("files")).select("doc_id", _main().alias("main"), "files").where(F.col("main").endswith(".tex"))

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PROJECTS_AT_ONCE):
                rows = []
                for row in batch.slice(at, PROJECTS_AT_ONCE).to_pylist():
                    try:
                        out = _assembled({f["path"]: f["content"] for f in row["files"]}, row["main"], types)
                    except Exception as e:  # whatever a project holds, the others get their results
                        out = _EMPTY | {"error": f"the project cannot be read: {type(e).__name__}"}
                    rows.append({"doc_id": row["doc_id"], "main": row["main"]} | out)
                yield pa.RecordBatch.from_arrays([_map_array([r[c] for r in rows]) if c == "source_map" else pa.array([r[c] for r in rows], t) for c, t in types.items()], list(types))

    return whole.mapInArrow(assemble, ", ".join(f"{c} {kinds_[c]}" for c in asked))


_SPAN = pa.struct([(name, pa.int32()) for name in texscan.Span._fields])
_ARROW = {
    "headings": pa.list_(pa.struct([("title", pa.string()), ("level", pa.int32()), ("char_start", pa.int32())])), "read": pa.list_(pa.string()), "bib_paths": pa.list_(pa.string()), "bib_declared": pa.bool_(), "source_map": pa.list_(_SPAN),
    "bib": pa.list_(pa.struct([("pos", pa.int32()), ("key", pa.string()), ("entry_type", pa.string()), ("fields", pa.map_(pa.string(), pa.string()))])),
}


def _map_array(maps: list[list[texscan.Span]]) -> pa.Array:
    """Source maps as a column, by numbers and not span by span."""
    every = np.fromiter(itertools.chain.from_iterable(itertools.chain.from_iterable(maps)), np.int32).reshape(-1, len(texscan.Span._fields))
    spans = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in every.T], fields=list(_SPAN))
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, maps)]), pa.int32()), spans)


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt by document to as many tasks as the session shuffles to, however few bytes they have."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id")


def bib_entries(files: DataFrame, projects: DataFrame) -> DataFrame:
    """Entries of each project's bibliography in order."""
    wanted = projects.select("doc_id", F.posexplode("bib_paths").alias("file_no", "path"))
    chosen = files.join(wanted, ["doc_id", "path"]).select("doc_id", "file_no", utf8(F.col("content")).alias("text")).where("text IS NOT NULL")

    def scan(batches):
        for pdf in batches:
            rows = []
            for d, n, text in zip(pdf["doc_id"], pdf["file_no"], pdf["text"], strict=True):
                rows += [(d, n, i, k, t, list(f.items())) for i, (k, t, f) in enumerate(_entries(unicodedata.normalize("NFC", text)))]
            yield pd.DataFrame(rows, columns=["doc_id", "file_no", "no", "key", "entry_type", "fields"])

    made = chosen.mapInPandas(scan, "doc_id string, file_no int, no int, key string, entry_type string, fields array<struct<k:string,v:string>>")
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("file_no", "no")) - 1
    return made.select("doc_id", place.alias("pos"), "key", "entry_type", F.map_from_entries("fields").alias("fields"))


def _entries(text: str) -> list[tuple[str, str, dict[str, str]]]:
    """A bibliography's entries; one that can't be read has none."""
    try:
        return list(bibtex.entries(text))
    except Exception:
        return []


_EMPTY = {"expanded": "", "preamble": "", "body": "", "visible": "", "structural": "", "text": "", "headings": [], "read": [], "bib_paths": [], "bib_declared": False, "source_map": [], "bib": []}


def _assembled(contents: dict[str, bytes], main: str, asked: Collection[str] = tuple(_EMPTY)) -> dict:
    """The columns of one project from its files' bytes; what takes time and isn't ``asked`` for is left out."""
    problem, sources, maps = None, {}, {}
    mapped = "source_map" in asked
    for path, raw in contents.items():
        try:
            sources[path], maps[path] = texscan.composed(bytes(raw).decode())
        except UnicodeDecodeError:
            # A bibliography that cannot be read leaves the rules over sources alone.
            problem = problem or ("a source is not UTF-8" if path.lower().endswith(".tex") else None)
    got = texscan.expand({k: v for k, v in sources.items() if k.endswith(".tex")}, main)
    full, head, body, start = got.text, got.text, "", 0
    if mark := latex.re.search(r"\\begin\s*\{document\}", full, latex.re.I):
        head, body, start = full[: mark.start()], full[mark.end() :], mark.end()
    reading = texscan.read(body if mark else full, mapped)
    spans = []
    if mapped:
        # From the plain text over the expanded source and the composed files to the files as they are.
        moved = [texscan._span((at, n, no, offset + start, m)) for at, n, no, offset, m in reading.spans] if start else reading.spans
        files = {no: [texscan.Span(at, n, no, offset, m) for at, n, _, offset, m in maps[path]] for no, path in enumerate(got.read)}
        spans = texscan.compose(texscan.compose(moved, {0: got.spans}), files)
    named = latex.bibliography_files(full, main)
    found = [p for p in named if p in sources] if named else sorted(p for p in sources if p.endswith(".bib"))
    last = {}
    if "bib" in asked:
        for pos, (key, kind, fields) in enumerate(e for p in found for e in _entries(unicodedata.normalize("NFC", sources[p]))):
            last.pop(key, None)
            last[key] = (pos, key, kind, list(fields.items()))
    return {
        "expanded": full, "preamble": head, "body": body, "visible": latex.visible(body), "structural": latex.structural(body), "text": reading.text,
        "headings": [{"title": h.title, "level": h.level, "char_start": h.start} for h in reading.headings], "read": got.read, "bib_paths": found,
        "bib_declared": bool(named) or any(p.lower().endswith(".bib") and p not in sources for p in contents), "error": problem or got.error, "source_map": spans, "bib": list(last.values()),
    }


ALIASES = {"annotation": ["аннотация", "реферат", "abstract"], "introduction": ["введение", "introduction"], "conclusion": ["заключение", "выводы", "выводы и рекомендации", "conclusion"]}
APPENDIX = r"(?iu)^(?:приложение|appendix)\s+([a-zа-яё0-9])(?![\p{L}\p{N}_])"


def by_distinct(values: Column, of: Callable[[str], object], kind: str) -> Column:
    """For arrays of texts the arrays of what ``of`` gives for each, asked once for every distinct text of a batch."""
    made = {"string": pa.string(), "array<int>": pa.list_(pa.int32())}[kind]

    @F.arrow_udf(f"array<{kind}>")
    def each(batch: pa.Array) -> pa.Array:
        flat = batch.flatten().dictionary_encode()
        got = pa.array([None if t is None else of(t) for t in flat.dictionary.to_pylist()], made).take(flat.indices)
        ends = np.cumsum([0, *(n or 0 for n in pc.list_value_length(batch).to_pylist())])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), got)

    return each(values)


#: Titles whose likeness a worker remembers; most documents share theirs.
TITLES_KNOWN = 65_536


@functools.lru_cache(TITLES_KNOWN)
def similar_kind(norm: str) -> str:
    """Kind of a title by an alias that it equals, or else resembles at 0.88."""
    from difflib import SequenceMatcher

    exact = next((k for k, names in ALIASES.items() if norm in names), None)
    return exact or next((k for k, names in ALIASES.items() if any(SequenceMatcher(None, norm, a).ratio() >= 0.88 for a in names)), "other")


def sections(spark: SparkSession, projects: DataFrame, collapse: bool = True) -> DataFrame:
    """Sections that cover each text: ``doc_id``, ``section_id``, ``title``, ``norm``, ``kind``, ``level``, ``char_start``, ``char_end``, ``locator``.

    ``collapse`` is for headings that nobody has freed of repetitions yet. Headings are read once, as one array a text, and go through one shuffle.
    """
    from ..functions.identity import locator, source_hash
    from ..functions.text import slug
    from ..operators.windows import section_ends, serial_ids

    # Of headings at most two characters behind the last one kept, or repeating its title, none is kept.
    def keep(acc, h):
        last = F.element_at(acc, -1)
        near = (h["char_start"] - last["char_start"] <= 2) | (h["norm"] == last["norm"])
        return F.when((F.size(acc) > 0) & F.coalesce(near, F.lit(False)), acc).otherwise(F.concat(acc, F.array(h)))

    def item(title: Column, level: Column, start: Column, norm: Column, section_id: str | None, kind: Column | None = None) -> Column:
        own = {"title": title, "level": level.cast("int"), "char_start": start.cast("int"), "norm": norm, "section_id": F.lit(section_id).cast("string")} | ({} if kind is None else {"kind": kind})
        return F.struct(*[v.alias(k) for k, v in own.items()])

    filler = lambda section_id, title: F.array(item(F.lit(title), F.lit(0), F.lit(0), F.lit(""), section_id, F.lit("document")))
    # Lengths and digests once a text, norms once a heading.
    heads = projects.select("doc_id", F.length("text").alias("total"), source_hash(F.col("text")).alias("digest"), F.transform("headings", lambda h: item(h["title"], h["level"], h["char_start"], plain_title(h["title"]), None)).alias("heads"))
    heads = heads.withColumn("heads", F.aggregate("heads", F.slice("heads", 1, 0), keep) if collapse else F.col("heads"))
    heads = heads.withColumn("kinds", by_distinct(F.transform("heads", lambda h: h["norm"]), similar_kind, "string"))
    named = F.zip_with("heads", "kinds", lambda h, k: item(h["title"], h["level"], h["char_start"], h["norm"], None, F.when(h["norm"].rlike(APPENDIX), "appendix").otherwise(k)))
    first = F.array_min(F.transform("heads", lambda h: h["char_start"]))
    every = F.when(F.size("heads") == 0, filler("document", "Документ")).when(first > 0, F.concat(filler("document-preamble", "Преамбула"), named)).otherwise(named)
    # Exploded as an expression: of a column Spark would filter the empty ones first and make all of it twice.
    rows = heads.select("doc_id", "total", "digest", F.explode(every).alias("h")).select("doc_id", "total", "digest", "h.*").withColumnRenamed("section_id", "own")
    base = F.when(F.col("kind") == "appendix", F.concat(F.lit("appendix-"), F.regexp_extract("norm", APPENDIX, 1))).when(F.col("kind") == "other", slug(F.col("title"))).otherwise(F.col("kind"))
    # What stands for text without a heading has an identifier of its own, beside any heading's.
    rows = rows.withColumn("base", F.when(F.col("own").isNull(), base))
    out = serial_ids(section_ends(rows, "doc_id", "char_start", F.col("total")), "doc_id", "base", "char_start", "section_id").withColumn("section_id", F.coalesce("own", "section_id"))
    cols = ["doc_id", "section_id", "title", "norm", "kind", "level", "char_start", "char_end"]
    return out.select(*cols, locator(F.col("digest"), F.col("char_start"), F.col("char_end")).alias("locator"))
