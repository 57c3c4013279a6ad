"""Personal data by weak supervision.

Regular expressions find base spans (email, ip, card, phone), which always stay.  Together with what these expressions
match but their checks refuse, and with what wider patterns propose (obfuscated addresses, local phone numbers, account
and identity numbers, names, street addresses, dates of birth), they are the candidates.  On every candidate, base spans
included, five labellers vote: a strict pattern, a gazetteer, the telling words around it, the characters that touch it,
and words that tell of something else.  Expectation-maximisation over the counts of vote patterns estimates how reliable
each labeller is on each kind, with a weak prior of fixed weight, and gives every pattern a posterior.  A hashed linear
span classifier is trained on these, scores every candidate, and decides on all that are not base spans.

Counts cover all documents; there are at most ``3 ** 5`` patterns a kind.  The classifier is trained on at most
``fit_spans`` distinct candidates, those with the least hash, each weighing as often as it occurs.  Texts are read once;
later steps read the candidates, which are written to the shared folder.

Positions are code points, ends exclusive.  All patterns run over whole texts in linear time.

Edge cases: a null text counts as empty and has no spans; without any candidate nothing is added; an added span touches
no base span, and of added spans that overlap the one with the best score stays; repeated rows are treated alike; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, slices
from .gazetteers import Gazetteers, issuer_known, public_address

BASE_KINDS = ("email", "ip", "card", "phone")
REFUSED_KINDS = ("ip_like", "card_like", "phone_like")
EXTRA_KINDS = (*REFUSED_KINDS, "email_words", "phone_local", "account", "id_number", "name", "address", "birth")
KINDS = BASE_KINDS + EXTRA_KINDS
FIT_SPANS = 5000
HASH_BITS = 12
THRESHOLD = 0.9
_CONTEXT = 48

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Grown from each @ to both sides; that finds what the pattern finds from the left, in linear time."""
    end = 0
    for m in _DOMAIN.finditer(text):
        if m.start() < end:
            continue
        start = m.start()
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            end = m.end()
            yield start, end


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) << (i & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_matches(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(start, rank of kind, end) of the base kinds, and of matches whose checks fail, both in order."""
    out = [(s, 0, e) for s, e in _emails(text)] if "@" in text else []
    refused = []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            fits = all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in m[0].split("."))
            (out if fits else refused).append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = "".join(_DIGIT.findall(m[0]))
            if 14 <= len(digits) <= 19:
                (out if luhn(digits) else refused).append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                fits = 10 <= len(_DIGIT.findall(m[0])) <= 15
                (out if fits else refused).append((m.start(), 3, m.end()))
    return sorted(out), [(s, r + len(BASE_KINDS) - 1, e) for s, r, e in sorted(refused)]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, rank of kind, end) of the base kinds, in order."""
    return base_matches(text)[0]


_UP, _LOW = "[A-ZÀ-ÖØ-Þ]", "[a-zß-öø-ÿ]"
_NAME = f"{_UP}{_LOW}{{1,20}}"
_TITLES = "Mr Mrs Ms Dr Prof Herr Frau Mme Sr Sra".split()
#: Candidates of the wider kinds that need no digit, and those that do.
_WORDY = {
    "email_words": re.compile(
        r"[A-Za-z0-9._-]{2,40} ?[\[(]? ?at ?[\])]? ?[A-Za-z0-9-]{2,40} ?[\[(]? ?dot ?[\])]? ?[A-Za-z]{2,6}(?![A-Za-z])"
    ),
    "name": re.compile(f"{_NAME}\\.? (?:{_UP}\\. )?{_NAME}(?: {_NAME})?"),
}
_DIGITED = {
    "phone_local": re.compile(r"\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9.-])"),
    "account": re.compile(r"(?:[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?|[0-9]{3}-[0-9]{2}-[0-9]{4})(?![A-Za-z0-9-])"),
    "id_number": re.compile(r"[0-9]{9,13}(?![0-9])"),
    "address": re.compile(f"[0-9]{{1,5}} (?:{_NAME} ){{1,3}}{_NAME}|[0-9]{{1,4}},? rue (?:\\w{{1,20}} ){{0,2}}{_NAME}|{_UP}[\\w-]{{2,30}} ?(?:straße|strasse|weg|platz|allee) [0-9]{{1,4}}"),
    "birth": re.compile(r"[0-9]{1,2}[./][0-9]{1,2}[./](?:19|20)[0-9]{2}(?![0-9])|(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}(?![0-9])"),
}
_STRICT = {
    "email": re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9_%+-]|\.(?!\.))*@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}"),
    "ip": re.compile(r"(?:(?:0|[1-9][0-9]{0,2})\.){3}(?:0|[1-9][0-9]{0,2})"),
    "phone": re.compile(r"[^()]*(?:\([0-9 ]+\)[^()]*)?"),
    "email_words": re.compile(r"\S+ ?[\[(] ?at ?[\])] ?\S+ ?[\[(] ?dot ?[\])] ?\S+"),
    "phone_local": re.compile(r"\([2-9][0-9]{2}\)[ -][2-9][0-9]{2}-[0-9]{4}|[2-9][0-9]{2}([.-])[2-9][0-9]{2}\1[0-9]{4}"),
    "name": re.compile(f"(?:{'|'.join(_TITLES)})\\.? .+"),
}
_SOCIAL = re.compile(r"(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}")
# Words near a candidate that tell of its kind, and words that tell of something else.
_TELLING = {
    "email": "email mail e contact address reach write courriel correo".split(),
    "ip": "ip address host server from login logged visitor client adresse dirección".split(),
    "card": "card visa mastercard credit debit pay payment carte tarjeta karte kreditkarte".split(),
    "phone": "phone tel telephone call mobile fax cell number telefon teléfono téléphone".split(),
    "account": "iban account bank konto compte cuenta transfer ssn social security".split(),
    "id_number": "passport id identity license licence ausweis pasaporte passeport dni nif ssn member patient".split(),
    "name": "name contact dear attn signed author regards by i am called named herr frau".split(),
    "address": "address lives live lived at street wohnt adresse dirección habite".split(),
    "birth": "born birth birthday dob geboren né née nacimiento nacido naissance".split(),
}
_KIND_OF = {"ip_like": "ip", "card_like": "card", "phone_like": "phone", "phone_local": "phone", "email_words": "email"}
_OTHERWISE = frozenset(
    "version release build total sum price cost eur usd kg page line chapter sha token hash key order invoice item part "
    "number serial model code section table figure".split()
)
_OPENING, _CLOSING = frozenset(" \t\r\n([<{'\",:;=/"), frozenset(" \t\r\n)]>}'\".,:;!?/")
NO, YES, NONE = 0, 1, 2
LABELLERS = ("pattern", "gazetteer", "context", "surroundings", "otherwise")
#: Rates of yes among a labeller's votes before any is seen, on what is no personal data and on what is; they weigh as
#: PRIOR_VOTES votes would, however many candidates there are.
FIRST_RATES = ((0.2, 0.9), (0.25, 0.85), (0.05, 0.5), (0.6, 0.95), (0.7, 0.95))
PRIOR_VOTES = 20.0


def _vote(x: bool) -> int:
    return YES if x else NO


def _remainder(text: str) -> int:
    """Of an account number's digits and letters, moved and read as one number, by 97."""
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97


def _strict(kind: str, found: str) -> int:
    kind = _KIND_OF.get(kind, kind) if kind in REFUSED_KINDS else kind
    digits = "".join(_DIGIT.findall(found))
    if kind == "ip":
        return _vote(bool(_STRICT["ip"].fullmatch(found)) and all(int(x) <= 255 for x in found.split(".")))
    if kind == "card":
        return _vote(luhn(digits))
    if kind == "phone":
        return _vote(10 <= len(digits) <= 15 and bool(_STRICT["phone"].fullmatch(found)))
    if kind == "account":
        return _vote(bool(_SOCIAL.fullmatch(found)) if found[0].isdigit() else _remainder(found.replace(" ", "")) == 1)
    if kind == "birth":
        a, b = (int(x) for x in re.split(r"[./-]", found)[1::-1]) if found[4:5] != "-" else (int(found[5:7]), int(found[8:10]))
        return _vote(1 <= min(a, b) and min(a, b) <= 12 and max(a, b) <= 31)
    return _vote(bool(_STRICT[kind].fullmatch(found))) if kind in _STRICT else NONE


def _listed(kind: str, found: str, lists: Gazetteers) -> int:
    kind = _KIND_OF.get(kind, kind) if kind in REFUSED_KINDS else kind
    words = re.findall(r"[^\W\d_]+", found)
    if kind in ("email", "email_words"):
        return _vote(bool(words) and words[-1].lower() in lists.domains)
    if kind == "ip":
        parts = [int(x) if len(x) < 9 else 999 for x in found.split(".")]
        return _vote(max(parts) <= 255 and public_address(parts))
    if kind == "card":
        return _vote(issuer_known("".join(_DIGIT.findall(found))))
    if kind == "phone":
        digits = "".join(_DIGIT.findall(found))
        return _vote(any(digits[:n] in lists.calling for n in (1, 2, 3)))
    if kind == "phone_local":
        return _vote(found.replace("(", "")[0] not in "01")
    if kind == "account":
        return NONE if found[0].isdigit() else _vote(lists.accounts.get(found[:2]) == len(found.replace(" ", "")))
    if kind == "name":
        return _vote(any(w in lists.given or w in lists.family for w in words))
    if kind == "address":
        return _vote(any(w.lower() in lists.streets or w.lower().endswith(("straße", "strasse")) for w in words))
    return NONE


class Candidate(NamedTuple):
    start: int
    rank: int
    end: int
    votes: int  # in base 3, the first labeller's first
    slots: list[int]


def _candidate(text: str, start: int, rank: int, end: int, lists: Gazetteers) -> Candidate:
    kind, found = KINDS[rank], text[start:end]
    before = re.findall(r"[^\W\d_]+", text[max(0, start - _CONTEXT) : start].lower())[-4:]
    after = re.findall(r"[^\W\d_]+", text[end : end + _CONTEXT // 2].lower())[:2]
    near = frozenset((*before, *after))
    votes = (
        _strict(kind, found),
        _listed(kind, found, lists),
        _vote(not near.isdisjoint(_TELLING[_KIND_OF.get(kind, kind)])),
        _vote((not start or text[start - 1] in _OPENING) and (end >= len(text) or text[end] in _CLOSING)),
        _vote(_OTHERWISE.isdisjoint(near)),
    )
    shape = re.sub("[0-9]+", "0", re.sub("[^\\W\\d_]+", "a", found))[:16]
    marks = [f"k{rank}", f"k{rank}s{shape}", f"k{rank}n{min(20, end - start)}"]
    marks += [f"k{rank}v{i}{v}" for i, v in enumerate(votes)]
    marks += [f"k{rank}b{w}" for w in before] + [f"k{rank}a{w}" for w in after]
    slots = [zlib.crc32(m.encode()) & ((1 << HASH_BITS) - 1) for m in marks]
    return Candidate(start, rank, end, int("".join(map(str, votes)), 3), slots)


def _wider(text: str) -> Iterator[tuple[int, int, int]]:
    """(start, rank of kind, end) of what the wider patterns propose."""
    for kind, pattern in (*_WORDY.items(), *(_DIGITED.items() if _DIGIT.search(text) else ())):
        if kind == "email_words" and " at " not in text and "at]" not in text and "at)" not in text:
            continue
        rank = KINDS.index(kind)
        for m in pattern.finditer(text):
            if not m.start() or not (text[m.start() - 1].isalnum() or text[m.start() - 1] in "._-+"):
                yield m.start(), rank, m.end()


def candidates(text: str, lists: Gazetteers) -> list[Candidate]:
    """Base spans and all other candidates, those that touch no base span, in order."""
    base, refused = base_matches(text)
    starts, reach = [s for s, _, _ in base], []
    for _, _, e in base:
        reach.append(max(e, reach[-1] if reach else 0))
    out = [_candidate(text, *x, lists) for x in base]
    for s, rank, e in (*refused, *_wider(text)):
        before = bisect_right(starts, e - 1)
        if not before or reach[before - 1] <= s:
            out.append(_candidate(text, s, rank, e, lists))
    return sorted(out)


class Reliability(NamedTuple):
    """For a kind: each pattern's posterior of being personal data, the share of personal data, and the rates of yes
    among each labeller's votes on what is none (first row) and what is (second row)."""

    posterior: np.ndarray
    share: float
    yes_rate: np.ndarray


def reliability(votes: np.ndarray, counts: np.ndarray, rounds: int = 500) -> Reliability:
    """Expectation-maximisation over the vote patterns (rows) of one kind and how often each occurs; a labeller that
    abstains says nothing, and votes are independent given the class."""
    first = np.array(FIRST_RATES).T
    yes, no = (votes == YES).astype(float), (votes == NO).astype(float)
    weight, rate, share, post = np.asarray(counts, float), first, 0.5, np.zeros(len(votes))
    for _ in range(rounds):
        log = np.log([1 - share, share]) + yes @ np.log(rate).T + no @ np.log1p(-rate).T
        new = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -500, 500)))
        done = np.abs(new - post).max(initial=0) < 1e-7
        post = new
        mass = np.vstack([weight * (1 - post), weight * post])
        rate = (mass @ yes + PRIOR_VOTES * first) / (mass @ (yes + no) + PRIOR_VOTES)
        share = float((mass[1].sum() + 1) / (weight.sum() + 2))
        if done:
            break
    return Reliability(post, share, rate)


def unpacked(votes: list[int]) -> np.ndarray:
    return np.array([[v // 3**i % 3 for i in range(len(LABELLERS) - 1, -1, -1)] for v in votes]).reshape(-1, len(LABELLERS))


def posteriors(counted: list[tuple[int, int, int]]) -> dict[tuple[int, int], float]:
    """The posterior of every (rank of kind, votes), from their counts."""
    out = {}
    for rank in sorted({r for r, _, _ in counted}):
        held = sorted((v, n) for r, v, n in counted if r == rank)
        found = reliability(unpacked([v for v, _ in held]), np.array([n for _, n in held]))
        out.update({(rank, v): float(p) for (v, _), p in zip(held, found.posterior, strict=True)})
    return out


def train(rows: list[tuple[list[int], float, int]], rounds: int = 400, rate: float = 0.5) -> np.ndarray:
    """Weights of a logistic model without bias on soft targets; a row is (slots, target, how often it occurs)."""
    weights = np.zeros(1 << HASH_BITS)
    if not rows:
        return weights
    row = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    slot = np.array([i for r in rows for i in r[0]])
    target, n = np.array([r[1] for r in rows]), np.array([r[2] for r in rows], float)
    each = np.bincount(slot, n[row], len(weights)) + 1.0
    for _ in range(rounds):
        z = np.bincount(row, weights[slot], len(rows))
        error = n * (1 / (1 + np.exp(-z)) - target)
        weights -= rate * np.bincount(slot, error[row], len(weights)) / each
    return weights


def candidate_rows(docs: DataFrame, id_col: str, text_col: str, lists: Gazetteers) -> DataFrame:
    """(id, found): every document with its candidates (s, r, e, v, f)."""

    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("s", pa.int32()), ("r", pa.int32()), ("e", pa.int32()), ("v", pa.int32()), ("f", pa.list_(pa.int32()))]))
        for batch in slices(batches):
            got = [[dict(zip("srevf", x, strict=True)) for x in candidates(t.as_py() or "", lists)] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, kind)], ["id", "found"])

    found = T._parse_datatype_string("array<struct<s:int,r:int,e:int,v:int,f:array<int>>>")
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return source.mapInArrow(propose, T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("found", found)]))


def find_personal_data(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    fit_spans: int = FIT_SPANS,
    threshold: float = THRESHOLD,
    lists: Gazetteers = Gazetteers(),
) -> DataFrame:
    """One row per document: id and spans, an array of (start, end, kind, base, score) by start and kind."""
    proposed = Scratch(docs.sparkSession, "pii").put(candidate_rows(docs, id_col, text_col, lists), "candidates")
    each = proposed.select(F.explode("found").alias("x")).select("x.r", "x.v", "x.f")
    counted = each.groupBy("r", "v").agg(F.count(F.lit(1)).alias("n")).collect()
    posterior = posteriors([tuple(r) for r in counted])
    # One row for each candidate, however often it occurs; it weighs as often.
    fit = each.groupBy("r", "v", "f").agg(F.count(F.lit(1)).alias("n"))
    fit = fit.orderBy(F.xxhash64("r", "v", "f"), "r", "v", "f").limit(fit_spans).collect()
    weights = train([(r["f"], posterior[r["r"], r["v"]], r["n"]) for r in fit])
    sent = docs.sparkSession.sparkContext.broadcast(weights)
    span = pa.struct(
        [("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("base", pa.bool_()), ("score", pa.float64())]
    )

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        for batch in slices(batches):
            out = [chosen([(x["s"], x["r"], x["e"], x["f"]) for x in held], w, threshold) for held in batch.column(1).to_pylist()]
            rows = [[dict(start=s, end=e, kind=KINDS[r], base=r < len(BASE_KINDS), score=p) for s, r, e, p in spans] for spans in out]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(span))], ["id", "spans"])

    kind = docs.schema[id_col].dataType
    spans = T.ArrayType(T._parse_datatype_string("struct<start:int,end:int,kind:string,base:boolean,score:double>"))
    made = proposed.mapInArrow(decide, T.StructType([T.StructField("id", kind), T.StructField("spans", spans)]))
    return made.select(F.col("id").alias(id_col), "spans")


def chosen(found: list[tuple[int, int, int, list[int]]], weights: np.ndarray, threshold: float) -> list[tuple[int, int, int, float]]:
    """(start, rank, end, score) of the base spans, and of the best of the other candidates that reach the threshold."""
    scored = [(s, r, e, 1 / (1 + math.exp(-float(np.clip(weights[f].sum(), -500, 500))))) for s, r, e, f in found]
    out = [x for x in scored if x[1] < len(BASE_KINDS)]
    taken: list[tuple[int, int]] = []
    for x in sorted((x for x in scored if x[1] >= len(BASE_KINDS) and x[3] >= threshold), key=lambda x: (-x[3], x)):
        at = bisect_right(taken, (x[2] - 1, math.inf))
        if not at or taken[at - 1][1] <= x[0]:
            taken.insert(at, (x[0], x[2]))
            out.append(x)
    return sorted(out)


def mask_personal_data(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans become one."""
    out, at = [], 0
    for start, end, kind in sorted(spans):
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join(out) + text[at:]
