"""Jobs over tables of pages, chunks and answers."""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from .graph import materialize
from .ranges import positions
from .slices import by_slices, slices

A_TAG = "(?is)<a\\s([^>]*)>(.*?)</a\\s*>"
HREF = "(?i)\\bhref\\s*=\\s*[\"']?([^\"'\\s>]*)"
MOST_LINKS, LINK_TEXT = 300, 160


def page_links(pages: DataFrame, cap: int = MOST_LINKS) -> DataFrame:
    """page_id, pos, href (absolute), text of each page's first ``cap`` links, first per href. The cap is the
    operator's: a page lists so many links."""
    attr = lambda name: F.regexp_extract("attrs", f"(?i)\\b{name}\\s*=\\s*[\"']([^\"']*)[\"']", 1)
    tags = F.arrays_zip(F.regexp_extract_all("html", F.lit(A_TAG), F.lit(1)).alias("attrs"), F.regexp_extract_all("html", F.lit(A_TAG), F.lit(2)).alias("inner"))
    links = pages.select("page_id", "url", F.posexplode(tags).alias("pos", "tag")).select("page_id", "url", "pos", "tag.attrs", "tag.inner")
    links = links.withColumn("href", T.decode_entities(F.regexp_extract("attrs", HREF, 1))).where("href != '' and not href rlike '(?i)^(javascript:|mailto:|tel:|#)'")
    links = links.withColumn("href", U.resolve(F.col("url"), F.col("href")))
    plain = F.trim(F.regexp_replace(T.decode_entities(F.regexp_replace("inner", "<[^>]*>", " ")), "\\s+", " "))
    alt = F.regexp_extract("inner", "(?i)\\balt\\s*=\\s*[\"']([^\"']*)[\"']", 1)
    links = links.withColumn("text", F.left(F.coalesce(*(F.nullif(c, F.lit("")) for c in (plain, attr("title"), alt, attr("aria-label"))), F.lit("")), F.lit(LINK_TEXT)))
    links = links.withColumn("nr", F.row_number().over(Window.partitionBy("page_id", "href").orderBy("pos"))).where("nr = 1")
    links = links.withColumn("place", F.row_number().over(Window.partitionBy("page_id").orderBy("pos")))
    return links.where(F.col("place") <= cap).select("page_id", F.col("place").cast("long").alias("pos"), "href", "text")


def _closing(text: str) -> dict[int, int]:
    """The place of the bracket that closes each opening one; an escaped one closes itself."""
    opened, closed = [], {}
    for m in re.finditer(r"[\[\]]", text):
        j = m.start()
        if text[j - 1 : j] == "\\":
            closed[j] = j
        elif m[0] == "[":
            opened.append(j)
        elif opened:
            closed[opened.pop()] = j
    return closed


def _markdown(text: str) -> list[tuple[str, str]]:
    found, spans, i, closed = [], [], 0, _closing(text)
    target = re.compile(r"\(\s*<?([^)\s>]+)>?(?:\s+\"[^\"]*\")?\s*\)")
    while (i := text.find("[", i)) >= 0:
        j = closed.get(i)
        m = target.match(text, j + 1) if j is not None else None
        if m:
            found.append((i, m[1], text[i + 1 : j].replace("\\", "")))
            spans.append((i, m.end()))
            i = m.end()
        else:
            i += 1
    starts = [a for a, _ in spans]
    for m in re.finditer(r"https?://[^\s<>()\[\]\"']+", text):
        k = bisect_right(starts, m.start()) - 1
        if k < 0 or m.start() >= spans[k][1]:
            found.append((m.start(), m[0].rstrip(".,;:!?"), ""))
    out = {}
    for _, href, label in sorted(found):
        if not re.match(r"(?i)(javascript:|mailto:|tel:|#)", href):
            out.setdefault(href, label.strip()[:LINK_TEXT])
    return list(out.items())


def markdown_links(docs: DataFrame) -> DataFrame:
    """doc_id, pos, href, text: inline links, nested brackets and escapes too, and bare urls."""

    def rows(doc: int | None, text: str | None) -> Iterator[tuple]:
        return ((doc, i, h, t) for i, (h, t) in enumerate(_markdown(text or ""), 1))

    run = by_slices("text", {"doc_id": pa.int64(), "pos": pa.int64(), "href": pa.string(), "text": pa.string()}, rows, "doc_id", "text")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, pos long, href string, text string")


def chunk_pages(pages: DataFrame, key: str = "doc_id", size: int = 4000, cap: int | None = None) -> DataFrame:
    """key, nr, n_chunks, chunk; the first ``cap`` chunks where it is given."""
    cut = pages.select(key, T.chunks(F.col("text"), size, cap).alias("c"))
    # The outer form: for the other Spark adds a filter that cuts each page twice more.
    cut = cut.select(key, F.size("c").cast("long").alias("n_chunks"), F.posexplode_outer("c").alias("nr", "chunk")).where("nr is not null")
    return cut.withColumn("nr", (F.col("nr") + 1).cast("long"))


def head_tail_chunks(chunks: DataFrame, key: str, cap: int = 7) -> DataFrame:
    """The first cap - 1 chunks and the last of a page that has more than ``cap``; all of other pages."""
    last = F.max("nr").over(Window.partitionBy(key))
    return chunks.withColumn("last", last).where((F.col("last") <= cap) | (F.col("nr") < cap) | (F.col("nr") == F.col("last"))).drop("last")


def unread_urls(wanted: DataFrame, pages: DataFrame, min_chars: int = 200) -> DataFrame:
    """Wanted urls without a page of ``min_chars`` trimmed characters under its requested or final url."""
    read = pages.where(F.length(F.trim("text")) >= min_chars).select(F.explode(F.array("requested_url", "url")).alias("url")).distinct()
    return wanted.join(read.hint("merge"), "url", "left_anti")


def document_urls(pages: DataFrame) -> DataFrame:
    """page_id, is_document, title of each page's url: a PDF by its path's ending, and the percent-decoded file name."""
    path = F.coalesce(U.part(F.col("url"), "PATH"), F.lit(""))
    file = F.regexp_extract(path, "([^/]*)$", 1)
    title = F.regexp_replace(F.coalesce(F.try_url_decode(F.replace(file, F.lit("+"), F.lit("%2B"))), file), "(?i)\\.pdf$", "")
    return pages.select("page_id", F.endswith(F.lower(path), F.lit(".pdf")).alias("is_document"), title.alias("title"))


def fallback_merge(primary: DataFrame, fallback: DataFrame, key: str = "url") -> DataFrame:
    """Pages of both; a blank primary page gives way to a fallback page that is not blank."""
    p, f = primary.select(key, F.col("text").alias("p")), fallback.select(key, F.col("text").alias("f"))
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    return p.join(f, key, "full_outer").select(key, F.when(blank(F.col("p")) & ~blank(F.col("f")), F.col("f")).otherwise(F.coalesce("p", "f")).alias("text"))


def align_by_ordinal(requests: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """Pairs each batch's requested urls with its results by position where the counts agree, else by url."""
    both = requests.join(results, key).withColumn("same", F.size("urls") == F.size("results"))
    place = both.where("same").select(key, F.explode(F.arrays_zip("urls", "results")).alias("x")).select(key, F.col("x.urls").alias("url"), F.col("x.results.text").alias("text"))
    wanted = both.where("not same").select(key, F.explode("urls").alias("url"), "results")
    by_url = wanted.select(key, "url", F.get(F.filter("results", lambda r: r["url"] == F.col("url")), F.lit(0))["text"].alias("text"))
    return place.union(by_url)


def literal_presence(values: DataFrame, passages: DataFrame) -> DataFrame:
    """values with ``present``: is the value in its own source's passages, case, white space and written-out
    addresses aside? The join is by source_url; each side's forms are made once, before it."""

    def forms(df: DataFrame, column: str, *keep: str) -> DataFrame:
        plain, spelt = T.folded(F.col(column)), T.folded(T.deobfuscate(F.col(column)))
        return df.select(*keep, plain.alias(column), spelt.alias("spelt")).withColumn(f"spelt_{column}", F.nullif("spelt", column)).drop("spelt")

    met = forms(values, "value", "id", "source_url").join(forms(passages, "text", "source_url"), "source_url", "left")
    seen = F.contains("text", "value") | F.contains(F.coalesce("spelt_text", "text"), F.coalesce("spelt_value", "value"))
    return met.groupBy("id").agg(F.coalesce(F.bool_or(seen), F.lit(False)).alias("present"))


def _repaired(raw: str) -> tuple[str | None, str]:
    """First balanced object of a model's answer, closed after its last complete inner object if cut."""
    text = re.sub(r"^\s*```[a-zA-Z]*\s*|\s*```\s*$", "", raw or "")
    start = text.find("{")
    if start < 0:
        return None, "none"
    depth, quoted, escaped, last = [], False, False, None
    for i in range(start, len(text)):
        c = text[i]
        if escaped or (quoted and c == "\\"):
            escaped = not escaped
        elif c == '"':
            quoted = not quoted
        elif not quoted and c in "{[":
            depth.append("}" if c == "{" else "]")
        elif not quoted and c in "}]" and depth and depth[-1] == c:
            depth.pop()
            if not depth:
                return text[start : i + 1], "object"
            if c == "}":
                last = (i, list(depth))
    if last is None:
        return None, "none"
    return text[start : last[0] + 1] + "".join(reversed(last[1])), "cut"


def repair_json(responses: DataFrame) -> DataFrame:
    """id, json, repair_kind (whole, object, cut, none). Only answers that are not JSON already go to Python."""
    tried = responses.withColumn("whole", F.expr("try_parse_json(response) is not null and ltrim(response) like '{%'"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = []
            for i, raw in zip(p["id"], p["response"], strict=True):
                found, kind = _repaired(raw)
                try:
                    json.loads(found or "")
                except ValueError:
                    found, kind = None, "none"
                rows.append((i, found, kind))
            yield pd.DataFrame(rows, columns=["id", "json", "repair_kind"])

    fixed = tried.where("not coalesce(whole, false)").select("id", "response").mapInPandas(run, "id long, json string, repair_kind string")
    return tried.where("whole").select("id", F.col("response").alias("json"), F.lit("whole").alias("repair_kind")).union(fixed)


_ABBREVIATION = re.compile(r"(?:\b(?:e\.g|i\.e|etc|Inc|Ltd|Co|Corp|Dr|Mr|Mrs|Ms|Prof|St|vs|No|approx|U\.S|U\.K|[A-Z])\.)$")


def _claims(text: str) -> list[str]:
    out, start, fence = [], 0, False
    for m in re.finditer(r"```|[.!?]+[\"'”’)]*(?:\s*\[\d+\])*(?=\s|$)|\n+", text):
        if m[0] == "```":
            fence = not fence
        elif not fence and not (m[0].startswith("...") or _ABBREVIATION.search(text[start : m.start() + 1]) and m[0] == "."):
            if piece := text[start : m.end()].strip():
                out.append(piece)
            start = m.end()
    return out + ([text[start:].strip()] if text[start:].strip() else [])


def split_claims(answers: DataFrame) -> DataFrame:
    """id, nr, claim: sentences, with citation marks kept on and abbreviations, decimals, ellipses and fenced
    code left whole."""

    def rows(i: int | None, text: str | None) -> Iterator[tuple]:
        return ((i, n, c) for n, c in enumerate(_claims(text or ""), 1))

    run = by_slices("answer", {"id": pa.int64(), "nr": pa.int64(), "claim": pa.string()}, rows, "id", "answer")
    return answers.select(F.col("id").cast("long").alias("id"), "answer").mapInArrow(run, "id long, nr long, claim string")


def mark_unsupported(claims: DataFrame, floor: float = 0.5) -> DataFrame:
    """id, answer: claims in order, failing ones marked; one without a score is not."""
    mark = F.when(F.col("score") < floor, F.concat("claim", F.lit(" [unsupported]"))).otherwise(F.col("claim"))
    held = claims.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("nr", mark.alias("claim")))).alias("c"))
    return held.select("id", F.array_join(F.transform("c", lambda x: x["claim"]), " ").alias("answer"))


def _fitting(texts: pd.Series, most_chars: int, level: int = 4) -> Iterator[tuple[pd.Series, bool]]:
    """Parts of a batch, in order, with at most ``most_chars`` characters, by halving it ``level`` times at most; items
    that are too long even so come with False."""
    if texts.str.len().sum() <= most_chars:
        yield texts, True
    elif len(texts) == 1 or level == 0:
        fits = texts.str.len() <= most_chars
        for i in range(len(texts)):
            yield texts.iloc[i : i + 1], bool(fits.iloc[i])
    else:
        half = len(texts) // 2
        yield from _fitting(texts.iloc[:half], most_chars, level - 1)
        yield from _fitting(texts.iloc[half:], most_chars, level - 1)


def _batches(batches: Iterator[pa.RecordBatch], most_chars: int) -> Iterator[tuple[pa.Array, pd.Series]]:
    """Ids, as Arrow holds them (pandas rounds large ones beside a null), and texts of batches that few halvings make fit."""
    for batch in slices(batches, "text", 4 * most_chars):
        yield batch.column("item_id"), pc.fill_null(batch.column("text"), "").to_pandas()


def score_with(items: DataFrame, scorer: Callable[[pd.Series], pd.Series], most_chars: int = 64_000) -> DataFrame:
    """item_id, score by a user's scorer of texts. A batch beyond ``most_chars`` is halved, four times at
    most; a single item beyond it has no score (see attach_scores for the default)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _batches(batches, most_chars):
            scores = [s for part, fits in _fitting(texts, most_chars) for s in (scorer(part) if fits else [None] * len(part))]
            yield pa.RecordBatch.from_arrays([ids, pa.array(scores, pa.float64(), from_pandas=True)], ["item_id", "score"])

    return items.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(run, "item_id long, score double")


ANSWER = "item_id long, question_id string, score double, choice string, level int, probabilities map<string,double>"
_ANSWER = pa.schema({"item_id": pa.int64(), "question_id": pa.string(), "score": pa.float64(), "choice": pa.string(), "level": pa.int32(), "probabilities": pa.map_(pa.string(), pa.float64())})


def answer_with(items: DataFrame, questions: list[dict], judge: Callable[[pd.Series, dict], list[dict]], most_chars: int = 64_000) -> DataFrame:
    """Answers of a user's judge to each question about each item, keyed by item and question id.

    A question is a dict with ``id``, ``kind`` and, by kind, ``options``: ``yes_no`` is answered by a ``score``, ``choice`` by
    the ``probabilities`` of its options (the likeliest one is ``choice``), ``level`` by those of its ordered options
    (``level`` is the likeliest one's place, from 0, and ``score`` the mean place as a share of the last). Batches are
    halved as in score_with; an item that is too long has no row, so that attach_scores gives the cautious value.
    """

    def told(question: dict, answer: dict) -> tuple:
        kind, found = question["kind"], answer.get("probabilities") or {}
        if kind == "yes_no":
            return answer.get("score"), None, None, None
        options = question["options"]
        best = max(options, key=lambda o: found.get(o, 0.0)) if found else None
        if kind == "choice":
            return found.get(best), best, None, found
        total = sum(found.get(o, 0.0) for o in options)
        mean = sum(i * found.get(o, 0.0) for i, o in enumerate(options)) / (total * (len(options) - 1)) if total and len(options) > 1 else None
        return mean, best, options.index(best) if best else None, found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _batches(batches, most_chars):
            ids, rows = ids.to_pylist(), []
            for part, fits in _fitting(texts, most_chars):
                rows += [(ids[i], q["id"], *told(q, a)) for q in questions for i, a in zip(part.index, judge(part, q), strict=True)] if fits else []
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type, from_pandas=True) for i, f in enumerate(_ANSWER)], schema=_ANSWER)

    return items.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(run, ANSWER)


def pack_batches(items: DataFrame, group: str, max_items: int = 192, max_chars: int = 57_600, block: int = 100_000) -> DataFrame:
    """group, item_id, batch: greedy batches in order of item within a group, by count and size; an item that is too
    large is a batch of its own, and one without a size counts as 0.

    Groups of up to ``block`` items are packed at once. A larger one is cut into blocks. Where a batch begins, the
    next one begins is found by binary search in running sums, and so where the first batch of the next block begins,
    for each place at which this block may be entered (the first ``max_items``); these tables, one a block, are followed
    from block to block, and then each block is packed from its own beginning.
    """
    items = items.select(group, F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("chars").cast("long"), F.lit(0)).alias("chars"))
    block = max(block, max_items)
    large = materialize(items.groupBy(group).agg(F.count("*").alias("n")).where(F.col("n") > block).select(F.col(group).alias("_g")), "large_groups")
    if not large.limit(1).count():
        return _pack_small(items, group, max_items, max_chars)
    same = F.col(group).eqNullSafe(F.col("_g"))
    small = _pack_small(items.join(large.hint("merge"), same, "left_anti"), group, max_items, max_chars)
    return small.union(_pack_large(items.join(large.hint("merge"), same, "left_semi"), group, max_items, max_chars, block))


def _pack_small(items: DataFrame, group: str, max_items: int, max_chars: int) -> DataFrame:
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("chars"), F.expr("cast(array() as array<int>)").alias("starts"))

    def step(s, x):
        full = (s["n"] == 0) | (s["n"] + 1 > max_items) | (s["chars"] + x["chars"] > max_chars)
        return F.struct((s["i"] + 1).alias("i"), F.when(full, 1).otherwise(s["n"] + 1).alias("n"), F.when(full, x["chars"]).otherwise(s["chars"] + x["chars"]).alias("chars"), F.when(full, F.concat(s["starts"], F.array(s["i"] + 1))).otherwise(s["starts"]).alias("starts"))

    held = items.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("item_id", "chars"))).alias("x"))
    held = held.select(group, "x", F.aggregate("x", start, step)["starts"].alias("starts"))
    batches = F.transform("starts", lambda a, b: F.slice("x", a, F.coalesce(F.get("starts", b + 1), F.size("x") + 1) - a))
    return held.select(group, F.posexplode(batches).alias("batch", "batch_items")).select(group, F.explode("batch_items").alias("o"), "batch").select(group, "o.item_id", F.col("batch").cast("long").alias("batch"))


def _next_starts(chars: np.ndarray, own: int, max_items: int, max_chars: int) -> np.ndarray:
    """Where the batch after one that begins at each of the first ``own`` items begins."""
    sums = np.cumsum(chars)
    begin = np.arange(own)
    first_over = np.searchsorted(sums, sums[:own] - chars[:own] + max_chars, side="right")
    return np.maximum(begin + 1, np.minimum(first_over, begin + max_items))


def _pack_large(items: DataFrame, group: str, max_items: int, max_chars: int, block: int) -> DataFrame:
    kind = items.schema[group].dataType.simpleString()
    placed = materialize(positions(items, [group], ["item_id", "chars"]).withColumn("block", F.floor(F.col("position") / block).cast("long")), "packing")
    # A batch that begins in a block ends within max_items items of the next one.
    ahead = placed.where((F.col("block") > 0) & (F.col("position") % block < max_items)).withColumn("block", F.col("block") - 1)
    blocks = placed.union(ahead)

    def parts(frame: pd.DataFrame) -> tuple[pd.DataFrame, int, np.ndarray]:
        frame = frame.sort_values("position")
        own = int((frame["position"] // block == frame["block"]).sum())
        return frame, own, _next_starts(frame["chars"].to_numpy(), own, max_items, max_chars)

    def crossing(frame: pd.DataFrame) -> pd.DataFrame:
        frame, own, after = parts(frame)
        leave, batches = [0] * own, [0] * own
        for i, j in zip(range(own - 1, -1, -1), after[::-1].tolist(), strict=True):
            leave[i], batches[i] = (j - own, 1) if j >= own else (leave[j], batches[j] + 1)
        return pd.DataFrame({group: frame[group].iloc[:1], "block": frame["block"].iloc[:1], "own": own, "leave": [leave[:max_items]], "batches": [batches[:max_items]]})

    def entering(frame: pd.DataFrame) -> pd.DataFrame:
        frame, entry, batch, found = frame.sort_values("block"), 0, 0, []
        for leave, batches in zip(frame["leave"], frame["batches"], strict=True):
            found.append((entry, batch))
            if entry < len(leave):
                entry, batch = int(leave[entry]), batch + int(batches[entry])
        return frame[[group, "block"]].assign(entry=[e for e, _ in found], batch=[b for _, b in found])

    def packed(frame: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
        frame, own, after = parts(frame)
        at, batch, out = int(entry["entry"].iloc[0]), int(entry["batch"].iloc[0]), np.full(len(frame), -1, np.int64)
        while at < own:
            out[at : after[at]] = batch
            at, batch = int(after[at]), batch + 1
        return frame[[group, "item_id"]].assign(batch=out)[out >= 0]

    crossings = materialize(blocks.groupBy(group, "block").applyInPandas(crossing, f"`{group}` {kind}, block long, own long, leave array<long>, batches array<long>"), "crossings")
    entries = materialize(crossings.groupBy(group).applyInPandas(entering, f"`{group}` {kind}, block long, entry long, batch long"), "entries")
    return blocks.groupBy(group, "block").cogroup(entries.groupBy(group, "block")).applyInPandas(packed, f"`{group}` {kind}, item_id long, batch long")
