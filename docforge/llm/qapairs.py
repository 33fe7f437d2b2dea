"""Problem 2: defective question and answer pairs, by a conditional random field over the clauses of each answer.

Each clause is tagged as answer, refusal, echo, foreign, unfinished or nothing (a stand-in); the share of the answer's words
under each tag decides on the pair's defect. The field is trained here, on a bounded sample of the table's own pairs whose
defects are made: clauses of the answers, the reasons copied and altered, clauses of other languages, answers cut at random,
and refusals, their look-alikes and stand-ins put together by a small grammar (``phrases``). Everything else covers all rows.
"""

from __future__ import annotations

import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docforge.llm.language import _OF, is_cjk, language
from docforge.llm.words import words
from docforge.llm.common import column, kept, mapped, sampled
from docforge.llm.cutoff import ending
from docforge.llm.phrases import ABSENT, CUES, HAN_CUES, lookalike, refusal, stand_in
from docforge.sources.tables import table

TAGS = ("answer", "refusal", "echo", "foreign", "unfinished", "nothing")
#: Pairs of the table that the training sample is made of, at most.
SAMPLE = 800
# What a cut leaves at the end of a made answer: mostly nothing, else an ellipsis or half of something.
CUT_MARKS = ("", "", "", "", "", "", "…", "...", " [", "&#8", "\\u00", "\ufffd")
#: Clauses of a training sequence, at most (answers of any length are tagged).
LONGEST = 14

_SENTENCE = re.compile(r"(?<=[.!?])[\"'”»)\]]*\s+(?=\S)|(?<=[。！？])[\"”»]*(?=\S)|\n+")
_QUOTED = re.compile(r"“[^“”]*”|«[^«»]*»|„[^„“]*“|\"[^\"\n]{20,}\"")
_MARKUP = re.compile(r"<[^<>]*>|&[#\w]+;")
_LEAD = re.compile(r"^(?:>+\s*|[QF]:\s*|[-*•]\s+|\d+[.)]\s+|\*\*[^*\n]{1,60}\*\*:?\s*|[A-Z][A-Z ]{4,40}:\s*)+")
_TOKEN = re.compile(r"[㐀-鿿]|[^\W_㐀-鿿]+")
_ENDED = re.compile(r"[.!?。！？]\W*\Z")
_MARK = re.compile(r"(?<![^\W_])[a-zäöüéè]+[A-Z]\w*|\b[A-Z]{2,}(?:[ _-][A-Z]+)*\b|\d+(?:\.\d+)*|\b[A-Z]\d+")


def clauses(text: str) -> list[str]:
    """Sentences and lines of an answer, without those that hold no letter or digit."""
    return [c for c in (x.strip() for x in _SENTENCE.split(text)) if any(ch.isalnum() for ch in c)]


def _tokens(text: str) -> list[str]:
    t = text.lower()
    return words(t) if t.isascii() else _TOKEN.findall(t)


class Reason:
    """What the clauses of an answer are compared with."""

    def __init__(self, text: str | None):
        ws = _tokens(text) if text else []
        self.pairs, self.words = set(zip(ws, ws[1:])), set(ws)
        self.marks = set(_MARK.findall(text)) if text else set()
        self.language = language(text, ws) if text else None
        self.known = bool(ws)


def _count(ws: list[str]) -> dict[str, int]:
    n: dict[str, int] = {}
    for w in ws:
        for lang in _OF.get(w, ()):
            n[lang] = n.get(lang, 0) + 1
    return n


N_FEATURES = 56


def features(clause: str, reason: Reason, last: bool, why: str | None, alone: bool) -> tuple[list[int], int]:
    """Numbers of the features that hold for a clause, and its size in tokens. ``why`` says why the answer looks
    unfinished, if it does."""
    bare = _LEAD.sub("", clause)
    rest = _QUOTED.sub(" ", bare)
    ws = _tokens(bare)
    size = len(ws)
    f = [0, 1 if last else 2]
    if last and why:
        f.append(3)
        f.append(4 if why in ("bare", "item", "stop") else 5)
        f.append(44 if size <= 2 else 45)
    # echo of the reason
    share = known = 0.0
    if reason.known and size:
        pairs = list(zip(ws, ws[1:]))
        share = sum(p in reason.pairs for p in pairs) / len(pairs) if pairs else float(ws[0] in reason.words)
        single = sum(w in reason.words for w in ws) / size
        marks = _MARK.findall(bare)
        known = sum(m in reason.marks for m in marks) / len(marks) if marks else single
        f.append(6 + (share >= 0.35) + (share >= 0.6) + (share >= 0.85))
        f.append(10 + (single >= 0.5) + (single >= 0.75) + (single >= 0.9))
        f.append(14 + (known >= 0.3) + (known >= 0.7) + (known >= 0.99))
        if share >= 0.5 and single >= 0.65 and known >= 0.7:
            f.append(18)
    else:
        f.append(19)
    # language, outside of what the clause quotes if there is enough of that
    own = _tokens(rest) if rest != bare else ws
    judged = own if len(own) >= 5 else ws
    han = is_cjk(rest if len(own) >= 5 else bare)
    if reason.language:
        if han:
            f.append(20 if reason.language != "zh" else 21)
        else:
            n = _count(judged)
            mine = n.get(reason.language, 0)
            best = max(n.values(), default=0)
            if reason.language == "zh":
                f.append(20 if best >= 2 else 22)
            elif best >= 2 and best > 1.5 * mine:
                f.append(20)
            elif mine >= 2:
                f.append(21)
            else:
                f.append(22)
    else:
        f.append(23)
    # refusal
    bits = first = 0
    for k, w in enumerate(rest.lower().replace("’", "'").split()):
        w = w.strip(".,;:!?()\"'")
        b = CUES.get(w, 0)
        if not b and "'" in w:
            for part in w.split("'"):
                b |= CUES.get(part, 0)
        bits |= b
        if k < 4:
            first |= b
    if han:
        for w, b in HAN_CUES:
            if w in rest:
                bits |= b
    for k in range(6):
        if bits >> k & 1:
            f.append(24 + k)
    n = (bits & 63).bit_count()
    f.append(30 + min(n, 4))
    if first & 1:
        f.append(35)
    f.append(36 + (size >= 4) + (size >= 9))
    if alone:
        f.append(39)
    own, sorry, unable, decline, helps, refer, views = (bits >> k & 1 for k in range(7))
    f += [x for x, on in ((40, own and unable), (41, unable and (helps or refer)), (42, decline and (own or helps or unable)), (43, sorry and (unable or decline or helps))) if on]
    if views:
        f.append(54 + own)
    # nothing said: a few words that speak of absence, and no end of a sentence
    absent = sum(w in ABSENT for w in ws)
    if size:
        f.append(46 + (absent > 0) + (absent == size))
    if alone and size <= 4:
        f.append(49)
        if absent == size:
            f.append(50 + bool(_ENDED.search(clause)))
    if reason.known and last and why and share >= 0.6:
        f.append(52 + (known >= 0.7))
    return f, size


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


class Field:
    """A linear-chain conditional random field over binary features; sequences are handled together, padded."""

    def __init__(self, emit: np.ndarray | None = None, move: np.ndarray | None = None):
        n = len(TAGS)
        self.emit = np.zeros((N_FEATURES, n)) if emit is None else emit
        self.move = np.zeros((n + 1, n)) if move is None else move  # the last row: from the start

    @staticmethod
    def _padded(sequences: list[list[list[int]]]) -> tuple[np.ndarray, np.ndarray]:
        length = max(map(len, sequences))
        x = np.zeros((len(sequences), length, N_FEATURES), dtype=np.float32)
        mask = np.zeros((len(sequences), length), dtype=bool)
        for i, s in enumerate(sequences):
            mask[i, : len(s)] = True
            for t, f in enumerate(s):
                x[i, t, f] = 1
        return x, mask

    def fit(self, sequences: list[list[list[int]]], tags: list[list[int]], steps: int = 80, rate: float = 0.2, penalty: float = 2e-3) -> "Field":
        """Maximum likelihood with an L2 penalty, by Adam on the exact gradient (forward and backward sums)."""
        x, mask = self._padded(sequences)
        size, length, _ = x.shape
        n = len(TAGS)
        y = np.zeros((size, length), dtype=int)
        for i, s in enumerate(tags):
            y[i, : len(s)] = s
        one = np.eye(n)[y] * mask[..., None]
        rows = x[mask]  # the clauses that there are; the padding has no features
        seen_emit = rows.T @ one[mask].astype(np.float32)
        seen_move = np.zeros_like(self.move)
        np.add.at(seen_move, (np.full(size, n), y[:, 0]), 1)
        for t in range(1, length):
            np.add.at(seen_move, (y[:, t - 1][mask[:, t]], y[:, t][mask[:, t]]), 1)
        moment = [np.zeros_like(self.emit), np.zeros_like(self.move)]
        square = [np.zeros_like(self.emit), np.zeros_like(self.move)]
        for step in range(1, steps + 1):
            score = np.zeros((size, length, n))
            score[mask] = rows @ self.emit.astype(np.float32)
            alpha = np.zeros((size, length, n))
            alpha[:, 0] = self.move[n] + score[:, 0]
            for t in range(1, length):
                alpha[:, t] = np.where(mask[:, t, None], _logsumexp(alpha[:, t - 1, :, None] + self.move[:n], 1) + score[:, t], alpha[:, t - 1])
            total = _logsumexp(alpha[:, -1], 1)
            beta = np.zeros((size, length, n))
            for t in range(length - 2, -1, -1):
                beta[:, t] = np.where(mask[:, t + 1, None], _logsumexp(self.move[:n] + (score[:, t + 1] + beta[:, t + 1])[:, None, :], 2), 0)
            p = np.exp(alpha + beta - total[:, None, None]) * mask[..., None]
            want_emit = rows.T @ p[mask].astype(np.float32)
            want_move = np.zeros_like(self.move)
            want_move[n] = p[:, 0].sum(0)
            for t in range(1, length):
                joint = np.exp(alpha[:, t - 1, :, None] + self.move[:n] + (score[:, t] + beta[:, t])[:, None, :] - total[:, None, None])
                want_move[:n] += (joint * mask[:, t, None, None]).sum(0)
            for k, (w, g) in enumerate(((self.emit, (seen_emit - want_emit) / size), (self.move, (seen_move - want_move) / size))):
                g = g - penalty * w
                moment[k] = 0.9 * moment[k] + 0.1 * g
                square[k] = 0.999 * square[k] + 0.001 * g * g
                w += rate * (moment[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)
        return self

    def tag(self, sequences: list[list[list[int]]]) -> list[list[int]]:
        """The likeliest tags of each sequence (Viterbi), sequences of like length together."""
        out: list[list[int]] = [[] for _ in sequences]
        n = len(TAGS)
        order = sorted((i for i, s in enumerate(sequences) if s), key=lambda i: len(sequences[i]))
        for k in range(0, len(order), 512):
            part = order[k : k + 512]
            length = max(len(sequences[i]) for i in part)
            score = np.zeros((len(part), length, n))
            flat = [(row, t, f) for row, i in enumerate(part) for t, f in enumerate(sequences[i])]
            sums = np.add.reduceat(self.emit[np.concatenate([f for _, _, f in flat])], np.r_[0, np.cumsum([len(f) for _, _, f in flat])[:-1]], axis=0)
            score[[r for r, _, _ in flat], [t for _, t, _ in flat]] = sums
            sizes = np.array([len(sequences[i]) for i in part])
            best, back = self.move[n] + score[:, 0], np.zeros((len(part), length, n), dtype=int)
            for t in range(1, length):
                step = best[:, :, None] + self.move[:n]
                back[:, t] = step.argmax(1)
                best = np.where((t < sizes)[:, None], step.max(1) + score[:, t], best)
            at = best.argmax(1)
            for row, i in enumerate(part):
                state, tags = int(at[row]), []
                for t in range(int(sizes[row]) - 1, -1, -1):
                    tags.append(state)
                    state = int(back[row, t, state])
                out[i] = tags[::-1]
        return out


def sequence(answer: str, reason: Reason) -> tuple[list[list[int]], list[int]]:
    """The features and sizes of an answer's clauses."""
    cs, why = clauses(answer), ending(answer)
    rows = [features(c, reason, k == len(cs) - 1, why, len(cs) == 1) for k, c in enumerate(cs)]
    return [r[0] for r in rows], [r[1] for r in rows]


def visible(text: str | None) -> bool:
    """Whether a text holds a letter or digit outside of markup."""
    return text is not None and any(c.isalnum() for c in _MARKUP.sub(" ", text))


def verdict(tags: list[int], sizes: list[int], known_reason: bool) -> str | None:
    """The defect of a pair by the share of the answer's tokens under each tag, and by the tag of its last clause."""
    share = np.zeros(len(TAGS))
    for t, s in zip(tags, sizes):
        share[t] += max(1, s)
    share /= share.sum()
    if share[5] > 0.5:
        return "empty"
    if share[1] >= 0.4:
        return "refusal"
    if known_reason and share[3] > 0.5:
        return "wrong_language"
    if tags[-1] == 4:
        return "truncated"
    return "copied_question" if known_reason and share[2] >= 0.9 else None


def _altered(text: str, r: random.Random, kind: int | None = None) -> str:
    ws = text.split(" ")
    rate = r.choice((0, 0, 0.05, 0.1, 0.15))
    ws = [r.choice(("the", "any", "each", "that", "this", "also")) if r.random() < rate else w for w in ws if r.random() > rate / 4]
    text = " ".join(ws)
    kind = r.randrange(6) if kind is None else kind
    if kind == 0:
        text = text.upper()
    elif kind == 1:
        text = f"“{text}”"
    elif kind == 2:
        text = "Q: " + text
    elif kind == 3 and len(ws) > 12:
        text = " ".join(ws[: r.randrange(len(ws) * 2 // 3, len(ws))])
    elif kind == 4:
        text = f"{text} {text}"
    return text


# Fragments of code behind an answer, and what may stand before a quoted sentence of another language.
_CODE = ("\n```\nlimit = {}\n```", "\n```\nTokenAge ::= INTEGER (0..{})\n```", "\n{{ \"age\": {} }}")
_QUOTING = ("They wrote:", "In the partner's own words:", "The remark was", "As noted at the meeting:", "")


def made(rows: list[tuple[str | None, str | None]], seed: int = 7) -> tuple[list, list]:
    """Sequences and tags made of pairs (reason, answer): proper answers (with the reason quoted before some), refusals,
    copied reasons, answers of another language (or with one such sentence), answers cut at random, and stand-ins."""
    r = random.Random(seed)
    good = []
    for q, a in rows:
        if q and visible(a) and a and not ending(a):
            reason = Reason(q)
            cs = clauses(a)
            if not cs or any(f in x for x, _ in (features(c, reason, False, None, False) for c in cs) for f in (18, 20, 33, 34, 48)):
                continue
            good.append((q, a, reason, cs))
    by_language: dict[str | None, list] = {}
    for g in good:
        by_language.setdefault(g[2].language, []).append(g)
    seqs, tags = [], []

    def add(text: str, reason: Reason, tag_of) -> None:
        cs, why = clauses(text), ending(text)
        if cs and len(cs) <= LONGEST:
            seqs.append([features(c, reason, k == len(cs) - 1, why, len(cs) == 1)[0] for k, c in enumerate(cs)])
            tags.append([tag_of(k, c, cs) for k, c in enumerate(cs)])

    for q, a, reason, cs in good:
        thing = " ".join(w for w in a.split() if any(ch.isupper() for ch in w[1:])) or "clause 5.1"
        thing = thing.split()[0].strip(".,;:“”()`*")
        add(a, reason, lambda *_: 0)
        if r.random() < 0.2:
            add(a, Reason(None), lambda *_: 0)
        if r.random() < 0.3:
            n_quoted = len(clauses(q))
            add(r.choice(("> ", "", "“")) + q + "\n" + a, reason, lambda k, c, cs, n=n_quoted: 2 if k < n else 0)
        if r.random() < 0.2:
            add(a + r.choice(_CODE).format(r.randrange(99)), reason, lambda *_: 0)
        for most in (1, 1, 3):
            add(" ".join(refusal(r, thing) for _ in range(r.randint(1, most))), reason if r.random() < 0.8 else Reason(None), lambda *_: 1)
        for rest in (a, cs[0], ""):
            if r.random() < 0.35:
                add(f"{lookalike(r, thing)} {rest}", reason, lambda *_: 0)
        if r.random() < 0.5:
            add(_altered(q, r), reason, lambda *_: 2)
        if r.random() < 0.3:
            add(stand_in(r), reason if r.random() < 0.8 else Reason(None), lambda *_: 5)
        others = [lang for lang in by_language if lang and reason.language and lang != reason.language]
        if others and r.random() < 0.6:
            other = r.choice(by_language[r.choice(others)])
            if r.random() < 0.7:
                add(other[1] + (r.choice(_CODE).format(r.randrange(99)) if r.random() < 0.3 else ""), reason, lambda *_: 3)
            else:
                add(f"{a} {r.choice(_QUOTING)} “{other[3][0]}” {r.choice(by_language[reason.language])[3][0] if r.random() < 0.5 else ''}", reason, lambda *_: 0)
        if r.random() < 0.3:
            add(cs[0], reason, lambda *_: 0)
        if r.random() < 0.4 and len(q) > 40:  # cut inside a sentence that is much like the reason
            piece = (r.choice((a, cs[0])) + " " + _altered(q, r, 6))[: -r.randrange(3, len(q) * 2 // 3)].rstrip() + r.choice(CUT_MARKS)
            if ending(piece) and len(clauses(piece)) > 1:
                add(piece, reason, lambda k, c, cs: 4 if k == len(cs) - 1 else 0)
        for whole, chance in ((a, 0.6), (cs[0], 0.5)):
            if len(whole) > 40 and r.random() < chance:
                piece = whole[: r.randrange(len(whole) // 2, len(whole) - 3)].rstrip() + r.choice(CUT_MARKS)
                if ending(piece):
                    add(piece, reason, lambda k, c, cs: 4 if k == len(cs) - 1 else 0)
    return seqs, tags


#: Answers in the sample that says which fields are the pairs' answers.
FIELDS = ("response_text", "gold_response")


def trained(spark: SparkSession, folder: str) -> Field:
    """The field, trained on at most SAMPLE pairs taken by hash over all rows; without usable pairs, on examples only. The
    weights are kept as a table in the shared folder and read by the next query on the same files."""
    rows = table(spark, folder, "change_requests")

    def fit() -> DataFrame:
        c = rows.where("reason_for_change is not null and gold_response is not null").select("cr_id", "reason_for_change", "gold_response")
        pairs = [(x.reason_for_change, x.gold_response) for x in sampled(c, "cr_id", SAMPLE, 2).collect()]
        field = Field().fit(*made(pairs + _EXAMPLES))
        return spark.createDataFrame([(field.emit.tolist(), field.move.tolist())], "emit array<array<double>>, move array<array<double>>")

    row = kept(rows, "crf", (SAMPLE, N_FEATURES, LONGEST), fit).first()
    return Field(np.array(row.emit), np.array(row.move))


# Pairs from which the field learns if the table has none.
_EXAMPLES = [
    ("Section 4 leaves open how long the cache holds a token after the reset.", "The cache holds a token for ten seconds after a reset. A note on testKey is added to section 4."),
    ("Es fehlt eine Regel, wie lange der Puffer nach dem Neustart eine Kennung hält.", "Der Puffer hält die Kennung zehn Sekunden, und eine Anmerkung zu testKey wird ergänzt."),
    ("Il manque une règle sur la durée pendant laquelle le tampon garde un jeton.", "Le tampon garde un jeton dix secondes, et une note sur testKey est ajoutée."),
]


def _tag_batch(field: Field, b: pa.RecordBatch) -> dict:
    out: dict[str, list] = {"cr_id": [], "answer_field": [], "defect": []}

    def add(i: int, name: str, defect: str | None) -> None:
        if defect:
            for key, value in zip(out, (i, name, defect)):
                out[key].append(value)

    rows, seqs, sizes, known = [], [], [], []
    for i, q, *answers in zip(*(column(b, x) for x in ("cr_id", "reason_for_change", *FIELDS))):
        reason = None
        for name, a in zip(FIELDS, answers):
            if not visible(a):
                add(i, name, "empty")
                continue
            reason = reason or Reason(q)
            s, n = sequence(a, reason)
            if s:
                rows.append((i, name))
                seqs.append(s)
                sizes.append(n)
                known.append(reason.known)
    for (i, name), tags, n, k in zip(rows, field.tag(seqs), sizes, known):
        add(i, name, verdict(tags, n, k))
    return out


def found(spark: SparkSession, folder: str) -> DataFrame:
    """p2_found: each pair with a defective answer and its defect. A null answer is empty; with a null or empty reason
    only empty, truncated and refusal are possible; an empty table gives no rows; repeated rows are judged alike."""
    field = trained(spark, folder)
    shared = spark.sparkContext.broadcast((field.emit, field.move))
    c = table(spark, folder, "change_requests").select("cr_id", "reason_for_change", *FIELDS)
    return mapped(c, lambda b: _tag_batch(_field(shared), b), "cr_id long, answer_field string, defect string")


@lru_cache(maxsize=2)
def _field(shared) -> Field:
    return Field(*shared.value)


def defect_counts(spark: SparkSession, folder: str) -> DataFrame:
    """How many pairs have each defect, by answer field."""
    return found(spark, folder).groupBy("answer_field", "defect").agg(F.count(F.lit(1)).alias("n_pairs"))
