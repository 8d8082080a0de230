"""Personal data: fixed patterns, secrets, and terms that give the data away.

Patterns find e-mail addresses, IP addresses, payment cards and phone numbers; strings that carry as much information
as only keys and tokens do are secrets. Each distinct value found is a protected entity, and so is what several values
have in common: a mail domain, a network, the issuer of a card, the area of a phone number. The corpus tells how much
a term reveals of an entity that it stands near: their pointwise mutual information against the entity's own
information content. Near the entity, terms that reveal at least a given share of it are generalised in the whole
document, and those that all but determine it are removed.

Probabilities are shares of documents. Every entity's terms are scored, whatever its number of texts. The share of a
term's documents that have it near the entity is taken as it is from a number of distinct texts with both on; from
fewer it is the lower end of its confidence interval, in which copies of one text count as one observation. What a
document adds to the counts grows with its entities' places, not with their number times the document's length.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm.scratch import Scratch, widened
from tarn.llm.words import bounded_batches, chunks, distinct_words, tidy

#: In the order in which spans are listed; the method adds ``secret`` and ``term``.
KINDS = ("email", "ip", "card", "phone")
SECRET, TERM = "secret", "term"
#: Words on either side of an entity that count as near it.
NEAR = 10
#: Characters of a secret, at least and at most, and changes between letters and digits in it, at least.
SECRET_CHARS, SECRET_CHANGES = (20, 512), 5
#: Candidate terms, and entities, up to which they and their counts are broadcast, 8 bytes each; with more of them all
#: terms are counted and joined.
MOST_BROADCAST = 1_000_000
#: Standard deviations to the lower end of a share's confidence interval (Wilson's, 95 %, one-sided).
CONFIDENCE = 1.645

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,}+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_WORD = re.compile(r"[^\W_]\w*")
_MIXED = re.compile(r"[0-9][A-Za-z]")
_KEY = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Each address is the run before an @ and the domain after it, so every @ is looked at once."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        else:
            done = at + 1
        at = text.find("@", max(done, at + 1))


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind and start; matches that fail a kind's test are dropped."""
    out = [("email", a, b) for a, b in _emails(text)]
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m.groups())]
    for m in _CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m[0])
        if len(digits) <= 19 and _luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


def secret_spans(text: str) -> list[tuple[str, int, int]]:
    """Strings of letters and digits in which the two change often, as in keys and tokens and not in words, names or dates."""
    if not _MIXED.search(text):
        return []
    out = []
    for m in _KEY.finditer(text):
        run = m[0]
        if len(run) <= SECRET_CHARS[1] and sum(x.isdigit() != y.isdigit() for x, y in zip(run, run[1:], strict=False) if x.isalnum() and y.isalnum()) >= SECRET_CHANGES:
            out.append((SECRET, m.start(), m.end()))
    return out


def all_spans(text: str) -> list[tuple[str, int, int]]:
    """Base spans, then secrets that overlap none of them."""
    base = base_spans(text)
    more = secret_spans(text)
    if base and more:
        more = [x for x in more if all(b <= x[1] or x[2] <= a for _, a, b in base)]
    return base + more


def entities(kind: str, value: str) -> tuple[str, ...]:
    """The protected entities that a span stands for: its kind and the value in one form, and what it belongs to."""
    if kind == "email":
        return f"email:{value.lower()}", f"domain:{value.lower().rpartition('@')[2]}"
    if kind == "ip":
        return f"ip:{value}", f"network:{value.rpartition('.')[0]}"
    if kind == SECRET:
        return (f"secret:{value.lower()}",)
    digits = re.sub("[^0-9]", "", value)
    return f"{kind}:{digits}", f"{'issuer' if kind == 'card' else 'area'}:{digits[:6]}"


def _near(text: str) -> dict[str, set[str]]:
    """The terms near each entity of a text; words within spans are none."""
    spans = all_spans(text)
    words = [(m.start(), m.end(), m[0].lower()) for m in _WORD.finditer(text)]
    ends = sorted((a, b) for _, a, b in spans)
    free, k, upto = [], 0, -1
    for a, b, word in words:
        # The furthest end of the spans that begin before this word ends.
        while k < len(ends) and ends[k][0] < b:
            upto = max(upto, ends[k][1])
            k += 1
        if a >= upto:
            free.append((a, word))
    out: dict[str, set[str]] = {}
    for kind, a, b in spans:
        at = bisect_left(free, (a, ""))
        terms = {x for _, x in free[max(0, at - NEAR) : at + NEAR]}
        for e in entities(kind, text[a:b]):
            out.setdefault(e, set()).update(terms)
    return out


def _listed(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _term_id(term: str) -> int:
    return xxhash.xxh64_intdigest(term.lower()) - (1 << 63)


def _read(docs: DataFrame, text: str) -> DataFrame:
    """Every row's base spans and secrets; the text too where there are any."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text"))
    schema = widened(rows.select("row", "doc_id").schema, n_email="long", n_ip="long", n_card="long", n_phone="long", n_secret="long", base_sha256="string", base="string", secrets="string", text="string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "_text"):
                counts, shas, lists, secrets, texts = [], [], [], [], []
                for value in part.column("_text").to_pylist():
                    spans = all_spans(value)
                    listed = _listed([x for x in spans if x[0] != SECRET])
                    counts.append([sum(k == x for x, _, _ in spans) for k in (*KINDS, SECRET)] if spans else [0] * (len(KINDS) + 1))
                    shas.append(hashlib.sha256(listed.encode()).hexdigest())
                    lists.append(listed)
                    secrets.append(_listed([x for x in spans if x[0] == SECRET]))
                    texts.append(value if spans else None)
                numbers = [pa.array(x, pa.int64()) for x in zip(*counts, strict=True)]
                out = [part.column("row"), part.column("doc_id"), *numbers, pa.array(shas), pa.array(lists), pa.array(secrets), pa.array(texts, pa.string())]
                yield pa.RecordBatch.from_arrays(out, names=schema.names)

    return rows.mapInArrow(tidy(run), schema)


def _pairs(held: DataFrame) -> DataFrame:
    """(row, same, e, t) for each entity and each term near it, by hash, of the texts of ``held`` (row, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: tuple[list, ...] = ([], [], [], [])
            for row, text in zip(*(batch.column(x).to_pylist() for x in ("row", "text")), strict=True):
                same = _term_id(text)
                for e, terms in _near(text).items():
                    of = _term_id(e)
                    for t in terms:
                        for column, value in zip(found, (row, same, of, _term_id(t)), strict=True):
                            column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["row", "same", "e", "t"])

    return held.select("row", "text").mapInArrow(tidy(run), "row long, same long, e long, t long")


def _entities(held: DataFrame) -> DataFrame:
    """(e, df_e): in how many rows of ``held`` (text) each entity is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [_term_id(e) for text in batch.column("text").to_pylist() for e in {e for k, a, b in all_spans(text) for e in entities(k, text[a:b])}]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], names=["e"])

    return held.select("text").mapInArrow(tidy(run), "e long").groupBy("e").agg(F.count(F.lit(1)).alias("df_e"))


def _term_frequencies(docs: DataFrame, text: str, only: np.ndarray | None) -> DataFrame:
    """(t, df): in how many documents each term occurs; all documents are read, all terms counted, or those in ``only``."""
    spark = docs.sparkSession
    wanted = spark.sparkContext.broadcast(only)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only = wanted.value
        # Counts of candidates leave a task once, those of all terms batch by batch.
        total = None if only is None else np.zeros(len(only), np.int64)
        for batch in batches:
            for part in chunks(batch, "_text"):
                names, codes, offsets = distinct_words(part.column("_text"))
                of, ids = [], []
                for code, name in enumerate(names):
                    for term in _WORD.findall(name):
                        of.append(code)
                        ids.append(_term_id(term))
                of, ids = np.array(of, np.int64), np.array(ids, np.int64)
                if only is not None and len(ids):
                    keep = only[np.minimum(np.searchsorted(only, ids), len(only) - 1)] == ids
                    of, ids = of[keep], ids[keep]
                if not len(ids):
                    continue
                # The places of words that hold a term, then one row per document and term.
                terms, number = np.unique(ids, return_inverse=True)
                first, size = np.searchsorted(of, np.arange(len(names))), np.bincount(of, minlength=len(names))
                doc = np.repeat(np.arange(part.num_rows), np.diff(offsets))
                some = size[codes] > 0
                codes, doc = codes[some], doc[some]
                many = size[codes]
                ends = np.cumsum(many)
                at = np.repeat(first[codes] - (ends - many), many) + np.arange(ends[-1] if len(ends) else 0)
                pairs = np.unique(np.repeat(doc, many) * len(terms) + number[at])
                n = np.bincount(pairs % len(terms), minlength=len(terms))
                if total is None:
                    yield pa.RecordBatch.from_arrays([pa.array(terms), pa.array(n)], names=["t", "n"])
                else:
                    total[np.searchsorted(only, terms)] += n
        if total is not None:
            found = np.nonzero(total)[0]
            yield pa.RecordBatch.from_arrays([pa.array(only[found]), pa.array(total[found])], names=["t", "n"])

    rows = docs.select(F.col(f"`{text}`").alias("_text")).where("_text is not null")
    return rows.mapInArrow(tidy(run), "t long, n long").groupBy("t").agg(F.sum("n").alias("df"))


def _least_share(share: Column, texts: Column) -> Column:
    """The lower end of the confidence interval of ``share``, of which ``texts`` observations are the successes."""
    z, trials = CONFIDENCE, texts / share
    middle = share + z * z / 2 / trials
    return (middle - z * F.sqrt(share * (1 - share) / trials + z * z / 4 / trials / trials)) / (1 + z * z / trials)


def disclosures(docs: DataFrame, read: DataFrame, text: str, share: float, certain: float, support: int) -> tuple[DataFrame, DataFrame] | None:
    """Which terms disclose which entities, (e, t, gone), and the pairs (row, same, e, t); None if there is none."""
    scratch = Scratch(docs.sparkSession)
    n, held = read.count(), read.where("text is not null")
    pairs = scratch.save(_pairs(held))
    together = pairs.groupBy("e", "t", "same").agg(F.count(F.lit(1)).alias("n"))
    together = scratch.save(together.groupBy("e", "t").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("texts")))
    candidates = scratch.save(together.select("t").distinct())
    size = candidates.count()
    if not size:
        return None
    only = np.sort(candidates.toArrow().column("t").to_numpy()) if size <= MOST_BROADCAST else None
    # One row a term, one row an entity: broadcast, terms and entities that are in very many pairs need no task of their own.
    frequencies, entities = scratch.save(_term_frequencies(docs, text, only)), scratch.save(_entities(held))
    few = [F.broadcast(x) if x.count() <= MOST_BROADCAST else x for x in (frequencies, entities)]
    found = together.join(few[0], "t").join(few[1], "e")
    of_term = F.least(F.col("n") / F.col("df"), F.lit(1.0))
    sure = F.when(F.col("texts") >= support, of_term).otherwise(_least_share(of_term, F.col("texts")))
    reveals = F.log2(sure * F.lit(float(n)) / F.col("df_e"))
    content = F.log2(F.lit(float(n)) / F.col("df_e"))
    found = found.where((content > 0) & (reveals >= share * content)).select("e", "t", (reveals >= certain * content).alias("gone"))
    found = scratch.save(found)
    scratch.drop(together, candidates, frequencies, entities)
    return found, pairs


def _added(held: DataFrame, pairs: DataFrame, found: DataFrame) -> DataFrame:
    """(row, starts, ends, gone): every place of a document's disclosing terms, outside its other spans."""
    found = F.broadcast(found) if found.count() <= MOST_BROADCAST else found
    flagged = pairs.join(found, ["e", "t"]).groupBy("row", "t").agg(F.max("gone").alias("gone"))
    flagged = flagged.groupBy("row").agg(F.collect_list("t").alias("ts"), F.collect_list("gone").alias("gones"))
    joined = flagged.join(held.select("row", "text"), "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, ends, gone = [], [], []
            for ts, gones, text in zip(*(batch.column(x).to_pylist() for x in ("ts", "gones", "text")), strict=True):
                level, taken = dict(zip(ts, gones, strict=True)), np.zeros(len(text) + 1, bool)
                for _, a, b in all_spans(text):
                    taken[a:b] = True
                spans = [(m.start(), m.end(), level[i]) for m in _WORD.finditer(text) if (i := _term_id(m[0])) in level and not taken[m.start() : m.end()].any()]
                starts.append([x[0] for x in spans])
                ends.append([x[1] for x in spans])
                gone.append([x[2] for x in spans])
            lists = [pa.array(x, pa.list_(pa.int64())) for x in (starts, ends)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), *lists, pa.array(gone, pa.list_(pa.bool_()))], names=["row", "starts", "ends", "gone"])

    return joined.mapInArrow(tidy(run), "row long, starts array<long>, ends array<long>, gone array<boolean>")


def sanitise(docs: DataFrame, text: str = "text", share: float = 0.8, certain: float = 0.95, support: int = 3) -> DataFrame:
    """Per row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone, n_secret, base_sha256, base, spans, n_spans, starts, ends, gone, text.

    base and spans list kind:start:end by kind and start (code points, end exclusive); spans has secrets and terms
    too, n_spans is their number. starts, ends and gone are those of the terms: gone ones are removed, others
    generalised by ``sanitised_texts``. text is the original where there is any span, else null. A term is flagged if
    it is near an entity (``NEAR`` words) and reveals ``share`` of its information, and removed from ``certain`` on.
    If both are in fewer than ``support`` distinct texts, the lower end of the confidence interval has to reveal it:
    for one entity and term in one document and no other, in corpora of 700 documents or more. Terms are all words,
    of one character or more. Terms overlap no other spans, secrets no base spans. Null and empty texts have no spans;
    very long texts are read whole, every pattern in linear time; repeated rows fare alike; an empty table gives no
    rows; other columns are not read, so their names cannot clash.
    """
    bounded_batches(docs.sparkSession)
    read = Scratch(docs.sparkSession).save(_read(docs, text))
    got = disclosures(docs, read, text, share, certain, support)
    if got is None:
        none = F.array().cast("array<long>")
        out = read.select("*", none.alias("starts"), none.alias("ends"), F.array().cast("array<boolean>").alias("gone"))
    else:
        out = read.join(_added(read.where("text is not null"), got[1], got[0]), "row", "left")
        out = out.withColumns({x: F.coalesce(x, F.array().cast(kind)) for x, kind in (("starts", "array<long>"), ("ends", "array<long>"), ("gone", "array<boolean>"))})
    terms = F.transform(F.arrays_zip("starts", "ends"), lambda x: F.concat(F.lit(f"{TERM}:"), x["starts"], F.lit(":"), x["ends"]))
    every = F.concat_ws(",", *[F.when(F.col(x) != "", F.col(x)) for x in ("base", "secrets")], F.when(F.size(terms) > 0, F.array_join(terms, ",")))
    many = sum((F.col(f"n_{x}") for x in (*KINDS, SECRET)), F.size("starts").cast("long"))
    return out.withColumns({"spans": every, "n_spans": many}).drop("row")


def redact(text: str, base: str, terms: list[tuple[int, int, bool]]) -> str:
    """``text`` with base spans as [KIND], generalised terms as [TERM] and removed terms taken out; overlaps are merged."""
    spans = [(int(a), int(b), f"[{k.upper()}]") for k, a, b in (x.split(":") for x in base.split(",") if x)]
    spans += [(a, b, "" if gone else f"[{TERM.upper()}]") for a, b, gone in terms]
    out, done = [], 0
    for a, b, into in sorted(spans):
        if b <= done:
            continue
        if a >= done:
            out += [text[done:a], into]
        done = b
    return "".join([*out, text[done:]])


def sanitised_texts(found: DataFrame) -> DataFrame:
    """doc_id and text of the rows of ``sanitise`` that have spans, without them; all other texts are as they were.

    Null and empty texts have no spans, so they are not among the rows; very long texts are rewritten whole; repeated
    rows each give one; ids may be null; an empty table gives no rows.
    """
    bounded_batches(found.sparkSession)
    listed = F.concat_ws(",", *[F.when(F.col(x) != "", F.col(x)) for x in ("base", "secrets")])
    rows = found.where("text is not null").select("doc_id", listed.alias("base"), "starts", "ends", "gone", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch.column(x).to_pylist() for x in ("text", "base", "starts", "ends", "gone"))
            texts = [redact(t, b, list(zip(s, e, g, strict=True))) for t, b, s, e, g in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.mapInArrow(tidy(run), rows.select("doc_id", "text").schema)
