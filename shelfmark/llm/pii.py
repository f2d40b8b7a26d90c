"""Personal data: labelers vote on candidate spans, EM weighs the votes, a classifier decides."""

import re
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import slices, stored
from shelfmark.llm.toxicity import fit_logistic

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret", "iban", "handle")
LABELERS = ("rule", "gazetteer", "context", "edges", "variety")
ABSTAIN, NO, YES = 0, 1, 2
EM_ROUNDS = 100
THRESHOLD = 0.5
CONTEXT = 40
SLICE_BYTES = 8 << 20

_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits is taken whole, so a long run is read once.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SECRET = re.compile(r"(?<![A-Za-z0-9])(?i:token|key|secret|password|passwd|api_key)[\"']?\x20?[=:]\x20?[\"']?([A-Za-z0-9_+/.-]{16,}+)")
_ACCESS_KEY = re.compile(r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])")
_IBAN = re.compile(r"(?<![A-Z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Z0-9])")
_HANDLE = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._-]{2,64}\x20?(?:\(at\)|\[at\])\x20?[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})+")
_DIGITS = re.compile(r"[0-9]")

# Gazetteers: endings of mail domains, calling codes, first digits of card numbers.
_ENDINGS = frozenset("com org net edu gov io co uk de fr es it eu us info dev app".split())
_CALLING = tuple("1 7 20 27 30 31 32 33 34 39 41 43 44 45 46 47 48 49 55 61 81 82 86 91".split())
_CARD_STARTS = ("34", "37", "4", "51", "52", "53", "54", "55", "60", "65")
_NEAR = re.compile(
    r"(?i)\b(?:e-?mail|mail|contact|write|call|tel|phone|mobile|fax|card|visa|credit|ip|host|address|from|token|key|secret|"
    r"password|iban|account)\b[^\n]{0,20}\Z")
_AWAY = re.compile(r"(?i)\b(?:version|ver|build|isbn|issn|page|section|figure|example|sample|order)\b[^\n]{0,10}\Z")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str):
    """Leftmost non-overlapping matches; only the surroundings of each ``@`` are read."""
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            yield start, m.end()
            free = m.end()
            at = text.find("@", free)
        else:
            at = text.find("@", at + 1)


def candidates(text: str) -> list[tuple[int, int, int, bool]]:
    """(kind number, start, end, base) of every span a pattern proposes; ``base`` passes the kind's own test."""
    found = [(0, s, e, True) for s, e in emails(text)]
    if _DIGITS.search(text):
        found += [(1, m.start(), m.end(), all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")))
                  for m in _IP.finditer(text)]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m[0].replace(" ", "").replace("-", "")
                if len(digits) >= 12:
                    found.append((2, m.start(), m.end(), len(digits) <= 19 and luhn(digits)))
        if "+" in text:
            for m in _PHONE.finditer(text):
                found.append((3, m.start(), m.end(), 9 <= sum(c.isdigit() for c in m[0]) <= 15))
        found += [(5, *m.span(), False) for m in _IBAN.finditer(text)]
    if "=" in text or ":" in text:
        found += [(4, *m.span(1), False) for m in _SECRET.finditer(text)]
    if "AKIA" in text or "ASIA" in text:
        found += [(4, *m.span(), False) for m in _ACCESS_KEY.finditer(text)]
    if "(at)" in text or "[at]" in text:
        found += [(6, *m.span(), False) for m in _HANDLE.finditer(text)]
    return found


def votes(text: str, kind: int, start: int, end: int, base: bool) -> tuple[int, ...]:
    """One vote of each labeler on a candidate."""
    span, name = text[start:end], KINDS[kind]
    digits = "".join(_DIGITS.findall(span))
    rule = YES if base else NO if name in BASE_KINDS else ABSTAIN
    if name == "iban":
        plain = span.replace(" ", "")
        value = "".join(str(int(c, 36)) for c in plain[4:] + plain[:4])
        rule = YES if int(value) % 97 == 1 else NO
    gazetteer = ABSTAIN
    if name in ("email", "handle"):
        gazetteer = YES if span.rsplit(".", 1)[-1].lower() in _ENDINGS else ABSTAIN
    elif name == "phone":
        gazetteer = YES if digits.startswith(_CALLING) else NO
    elif name == "card":
        gazetteer = YES if digits.startswith(_CARD_STARTS) else NO
    elif name == "ip":
        gazetteer = NO if span.startswith(("0.", "127.", "255.")) else ABSTAIN
    before = text[max(0, start - CONTEXT):start]
    context = YES if _NEAR.search(before) else NO if _AWAY.search(before) else ABSTAIN
    left, right = text[start - 1:start], text[end:end + 1]
    edges = NO if left and (left.isalnum() or left in "_.") or right.isalnum() else YES
    variety = ABSTAIN
    if name == "secret":
        variety = YES if digits and len(set(span)) >= 8 else NO
    elif name != "email":
        variety = NO if digits and len(set(digits)) <= 2 else YES if len(set(digits)) >= 4 else ABSTAIN
    return rule, gazetteer, context, edges, variety


def _code(kind: int, cast: tuple[int, ...]) -> int:
    code = kind
    for v in cast:
        code = code * 3 + v
    return code


def _cast(code: int) -> tuple[int, tuple[int, ...]]:
    out = []
    for _ in LABELERS:
        code, v = divmod(code, 3)
        out.append(v)
    return code, tuple(reversed(out))


CANDIDATE = "struct<kind:int,start:int,end:int,base:boolean,code:int>"


def find_candidates(docs: DataFrame) -> DataFrame:
    """doc_id and the candidates of its whole text, with their votes as a code."""
    arrow = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("code", pa.int32())]))

    def run(batches):
        for part in slices(batches, "text", SLICE_BYTES):
            out = []
            for text in part.column("text").to_pylist():
                out.append([
                    {"kind": k, "start": s, "end": e, "base": b, "code": _code(k, votes(text, k, s, e, b))}
                    for k, s, e, b in candidates(text)
                ])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(out, arrow)], ["doc_id", "found"])

    return docs.select(F.col("doc_id").cast("bigint"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(
        run, f"doc_id bigint, found array<{CANDIDATE}>")


def estimate(counts: dict[int, int], rounds: int = EM_ROUNDS) -> dict[int, float]:
    """P(personal data) of each vote pattern, by Dawid-Skene EM over the pattern counts of all candidates.

    Each kind has its own prevalence; a labeler has one table of vote rates for true and for
    false candidates. It starts from the majority of the votes.
    """
    codes = sorted(counts)
    if not codes:
        return {}
    n = np.array([counts[c] for c in codes], float)
    kinds = np.array([_cast(c)[0] for c in codes])
    cast = np.array([_cast(c)[1] for c in codes])
    p = ((cast == YES).sum(1) + 0.5) / ((cast == YES).sum(1) + (cast == NO).sum(1) + 1.0)
    for _ in range(rounds):
        prior = np.array([((n * p)[kinds == k].sum() + 1) / (n[kinds == k].sum() + 2) for k in range(len(KINDS))])
        score = np.log(prior[kinds]) - np.log1p(-prior[kinds])
        for j in range(cast.shape[1]):
            rate = np.array([[(n * q)[cast[:, j] == v].sum() + (1.0 if v == ABSTAIN else 2.0 if v == want else 0.5)
                              for v in (ABSTAIN, NO, YES)] for q, want in ((p, YES), (1 - p, NO))])
            rate /= rate.sum(1, keepdims=True)
            score += np.log(rate[0, cast[:, j]]) - np.log(rate[1, cast[:, j]])
        nxt = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
        if np.abs(nxt - p).max() < 1e-9:
            break
        p = nxt
    return dict(zip(codes, p.tolist(), strict=True))


def classifier(counts: dict[int, int], soft: dict[int, float]) -> set[int]:
    """Codes the final classifier accepts: a logistic model of kind and votes fitted to the EM posteriors."""
    codes = sorted(counts)
    if not codes:
        return set()
    x = np.array([_features(c) for c in codes])
    n, p = np.array([counts[c] for c in codes], float), np.array([soft[c] for c in codes])
    n = n / n.sum() * min(n.sum(), 1e6)
    w = fit_logistic(np.vstack([x, x]), np.r_[np.ones(len(x)), np.zeros(len(x))], np.r_[n * p, n * (1 - p)], prior=1e-3)
    return {c for c, s in zip(codes, x @ w, strict=True) if s >= np.log(THRESHOLD / (1 - THRESHOLD))}


def _features(code: int) -> list[float]:
    kind, cast = _cast(code)
    return [1.0, *(float(kind == k) for k in range(1, len(KINDS))), *(float(v == w) for v in cast for w in (NO, YES))]


def learn(found: DataFrame) -> set[int]:
    """Accepted codes, from the counts of vote patterns over all documents (at most 7 x 3^5 of them)."""
    rows = found.select(F.explode("found").alias("c")).groupBy("c.code").count().collect()
    counts = {r.code: r["count"] for r in rows}
    return classifier(counts, estimate(counts))


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans and n_spans, one row per row of ``docs``.

    ``spans`` holds the base spans and the candidates the classifier accepts, as kind:start:end in code
    points (end exclusive), by start, then kind. Null and empty texts have none (empty
    string); repeated rows give repeated results; an empty table gives no rows; other columns are not read.
    """
    found = stored(find_candidates(docs), "candidates")
    accepted = sorted(learn(found))
    ok = F.array(*[F.lit(c) for c in accepted]) if accepted else F.array().cast("array<int>")
    names = F.array(*[F.lit(k) for k in KINDS])
    written = lambda kept: F.array_join(F.transform(
        F.array_sort(F.transform(kept, lambda c: F.struct(c["start"], c["kind"], c["end"]))),
        lambda c: F.concat_ws(":", F.element_at(names, c["kind"] + 1), c["start"], c["end"])), ",")
    base = F.filter("found", lambda c: c["base"])
    kept = F.filter("found", lambda c: c["base"] | F.array_contains(ok, c["code"]))
    return found.select(
        "doc_id",
        *[F.size(F.filter(base, partial(lambda k, c: c["kind"] == k, k))).cast("long").alias(f"n_{name}")
          for k, name in enumerate(BASE_KINDS)],
        F.sha2(written(base), 256).alias("base_sha256"),
        written(kept).alias("spans"),
        F.size(kept).cast("long").alias("n_spans"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with each found span replaced by its kind in angle brackets; ``n_chars`` follows the text.

    Overlapping spans are replaced once, by the kind of the first. Null texts stay null; other columns
    pass unchanged.
    """
    accepted = learn(stored(find_candidates(docs).select("found"), "candidates"))
    size = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def clean(text: str | None) -> str | None:
        if text is None:
            return None
        spans = sorted((s, k, e) for k, s, e, b in candidates(text)
                       if b or _code(k, votes(text, k, s, e, b)) in accepted)
        out, at = [], 0
        for s, k, e in spans:
            if s >= at:
                out += [text[at:s], f"<{KINDS[k]}>"]
            at = max(at, e)
        return "".join([*out, text[at:]])

    def run(batches):
        for part in slices(batches, "text", SLICE_BYTES):
            old = part.column("text").to_pylist()
            new = [clean(t) for t in old]
            columns = part.columns
            columns[part.schema.get_field_index("text")] = pa.array(new, part.schema.field("text").type)
            if size is not None:
                kind = part.schema.field(size).type
                kept = part.column(size).to_pylist()
                columns[size] = pa.array([n if a == b else len(b) for n, a, b in zip(kept, old, new, strict=True)], kind)
            yield pa.RecordBatch.from_arrays(columns, schema=part.schema)

    return docs.mapInArrow(run, docs.schema)
