"""Problem 2: defective question-answer pairs with their defect.

Method: noisy labelling functions vote for or against each defect or abstain;
an expectation-maximization label model per defect estimates how far each
function can be trusted and gives every pair a posterior. The functions of one
defect look at different evidence (for a truncated answer: its end, what
stands open, its last list item or table row, its length at the store's limit),
so that their votes can differ. The model is fitted on the counts of vote
patterns over all pairs, of which a defect has at most 3 to the number of its
functions. The letter model of languages is counted over all texts; of it, the
counts of trigrams by language reach the driver, whose number the alphabets
bound. So nothing that grows with the rows reaches the driver.

A pair keeps every defect whose posterior reaches the defect's cutoff. The
cutoffs are validated on all pairs by cross-validation: the pairs fall into
folds, each fold is judged by a label model fitted on all other folds, and its
sound pairs stand against the same pairs with a defect of known type put in (cut
inside the answer, the question set again, an answer to a question in another
language, an answer without content, a refusal in the answer's place).
"""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm._shared import texts_of, words
from tallyloom.session import materialize

DEFECTS = ("empty", "truncated", "refusal", "copy", "language")
#: Folds of the cross-validation of cutoffs.
FOLDS = 8
#: Pairs and characters that one task holds at a time, about, while defects are put in.
GROUP_ROWS, GROUP_CHARS = 2_000, 20_000_000
#: Longest answer that the store keeps.
STORED_LENGTH = 500

# Frequent function words by language.
FUNCTION_WORDS = {
    "en": "the of and in for was is to from that by on with it this what which how did does had were are has year before compared page its at be not or an as i you they their than would could",
    "de": "der die das und ist nicht mit für von bei lag war betrug weist einen wert aus nach im jahr davor laut grund dafür vor allem wie hoch welchen nennt wenn es um geht keine ich leider diese kann mir dazu eine einem den dem des auf wurde wurden sich auch als zum zur ein einer sind hat zu über durch",
    "fr": "le la les des du de un une et est pour dans sur selon contre avant était données tient surtout aux ce qui quel quelle combien chez je ne peux pas cette à au par après avec sont été en elle il son ses plus an d l s",
    "es": "el la los las de del un una y es en para por según frente año anterior fue alcanzó sobre todo mayor cuál cuánto cifra no puedo esa lo siento datos que con su se al qué cómo más a",
    "it": "il lo la gli di della del dei nel nella per con secondo bilancio contro anno dell prima è stato sono che da un una non le dal alla più quanto a",
    "pt": "o os as do da dos das em no na um uma por para com foi ano anterior não é segundo relatório de parte causa que se mais pelo pela a boa",
    "nl": "het een van de en in op voor met is was dat niet volgens jaar aan door bij zijn werd dan deze ten opzichte vorig te",
}
# Texts that stand in for an answer, in letters and digits only.
STAND_INS = frozenset("answer|antwort|réponse|reponse|respuesta|risposta|resposta|response|result|a|na|n a|none|null|nil|nan|no content|no answer|no response|empty|empty answer|empty response|tbd|tba|unknown|undefined|blank|void|not available|not applicable|missing|final answer|sources|source|pending|content|text".split("|"))
# Searched in lower case, as branches of a pattern that ignores case are all tried in full at every word.
REFUSING = re.compile(
    r"\b(?=[a-z])(?:cannot|can ?not|can't|unable|not able|won't|refrain|declin\w+|not permitted|rather not|no answer|not? have access|don't have|don't know|do not know|insufficient|isn't enough|not enough|not be appropriate|not appropriate|outside what|past what i|beyond (?:the|what|my)|nothing on file|no information|isn't in my|not in my|none of (?:the|them|my)|could not|couldn't|language model|prevents? me|apolog\w+|sorry|regrettably|unfortunately|cannot comply|not (?:something|allowed)"
    r"|leider|nicht (?:beantworten|möglich|bekannt|sagen|nennen)|keine? (?:angabe|information|auskunft|daten|antwort)\w*|liegen mir|darf ich|nicht vor"
    r"|désolé\w*|impossible|aucune? (?:donnée|information|réponse)|pas en mesure|malheureusement|ne (?:me |m')?(?:peux|permet\w*|puis|dispos\w+|figure|trouve)"
    r"|lo siento|lamento|no (?:puedo|dispongo|tengo|es posible|me es|encuentro|figura|podemos|hay)|desgraciadamente|lamentablemente"
    r"|non (?:posso|dispongo|sono)|mi dispiace|purtroppo|não (?:posso|tenho|disponho)|desculpe|infelizmente)"
)
# Words by which an answer speaks of itself, the asker, the question or what it was given, instead of the matter.
SPEAKING = frozenset(
    "i me my mine myself you your question answer request respond reply discuss documents context excerpts materials provided information help assist ask asking ich mir mich mein meine frage antwort beantworten unterlagen dokumente auskunft sie ihnen "
    "je moi mon ma question réponse répondre documents demande vous mi mis yo pregunta respuesta responder contestar documentos solicitud usted io domanda risposta rispondere documenti eu pergunta resposta".split()
)
FIGURE = re.compile(r"[$€£]\s?-?\d|\d[\d.,]*\s*(?:million|billion|trillion|thousand|percent|%|mio|mrd|millones|millions|milliards?|milion\w+|milhões|basis points)|\d{1,3}(?:[.,]\d{3})+|\b\d+[.,]\d+\b", re.I)
_QUOTED = re.compile("[\"“”„«‹][^\"“”„«»‹›\n]*[\"“”»›]|【[^】]*】|\\[[^\\]]*\\]")
_FIGURE_END = r"[-–]?[$€£]?\s?-?\d[\d.,]*\d?\s*(?:million|billion|trillion|thousand|percent|%)?"
_BARE = re.compile(rf"^\W*{_FIGURE_END}\W*$", re.I)
_LABELLED = re.compile(rf"^[^.!?|]*:\W*{_FIGURE_END}\W*$", re.I)
_STOPPED = re.compile(r"[.!?。…][\"'”’»)\]】*_`\s]*$")
_CUT_FIGURE = re.compile(r"[$€£]\d{1,3}\.[\"'*_\s]*$")
_CITED = re.compile(r"(?:】|\]|\))[*_\s]*$")
_LABEL = ("question", "q", "frage", "pregunta", "you asked", "asked", "you", "prompt", "a", "answer", "antwort", "réponse", "respuesta")
_LABELS = {w for x in _LABEL for w in x.split()}
_LETTERS = re.compile(r"[^\W\d_]+")


_LATEST: dict[str, tuple[str, ...]] = {}  # a pair's texts are looked at more than once


def bare_words(text: str) -> tuple[str, ...]:
    """Words without quoted names, citations, figures' units and capitalised names."""
    known = _LATEST.get(text)
    if known is not None:
        return known
    if len(_LATEST) >= 8:
        _LATEST.clear()
    plain = _QUOTED.sub(" ", text)
    if not plain.isupper():
        kept = []
        for line in plain.split("\n"):
            first = True  # word of a sentence
            for w in line.split():
                if first or w[0].islower() or len(w) < 4:
                    kept.append(w)
                first = w[-1] in ".!?:"
        plain = " ".join(kept)
    known = _LATEST[text] = tuple(_LETTERS.findall(plain.lower()))
    return known


_INDEX: dict[str, list[tuple[str, float]]] = {}
for _lang, _list in FUNCTION_WORDS.items():
    for _w in set(_list.split()):
        _INDEX.setdefault(_w, []).append((_lang, 1.0))
_INDEX = {w: [(lang, 1.0 / len(v)) for lang, _ in v] for w, v in _INDEX.items()}


def language_by_words(ws: Iterable[str]) -> tuple[str | None, float]:
    """The language whose function words weigh most, and its lead over the next."""
    score: dict[str, float] = {}
    for w in ws:
        if w in _INDEX:
            for lang, v in _INDEX[w]:
                score[lang] = score.get(lang, 0.0) + v
    if not score:
        return None, 0.0
    top = max(score, key=score.__getitem__)
    best = score.pop(top)
    return (top, best - max(score.values(), default=0.0)) if best >= 0.5 else (None, 0.0)


def own_language(question: str, answer: str) -> str | None:
    """The language of both, if function words tell that they share one."""
    ws = bare_words(answer)
    lang = language_by_words(bare_words(question))[0] if len(ws) >= 6 else None
    return lang if lang and language_by_words(ws)[0] == lang else None


#: Letters beyond a to z that a language writes.
LETTERS = {"en": "", "de": "äöüß", "fr": "àâæçéèêëîïôœùûüÿ", "es": "áéíñóúü", "it": "àèéìíîòóùú", "pt": "ãáàâçéêíõóôúü", "nl": "áéëïóöü"}
NO_LANGUAGE = (None, 0.0)


class LanguageWords:
    """Counts of words by language, of texts whose function words are decisive."""

    REMEMBERED = 200_000

    def __init__(self) -> None:
        self.by: dict[str, Counter] = {}

    def add(self, text: str) -> None:
        ws = bare_words(text)
        lang, lead = language_by_words(ws)
        if lang and lead >= 2:
            self.by.setdefault(lang, Counter()).update(ws)

    def full(self) -> bool:
        return sum(map(len, self.by.values())) > self.REMEMBERED

    def trigrams(self) -> dict[str, Counter]:
        """Counts of trigrams by language; the words are forgotten."""
        out: dict[str, Counter] = {}
        for lang, ws in self.by.items():
            c = out[lang] = Counter()
            for w, n in ws.items():
                p = f" {w} "
                for i in range(len(p) - 2):
                    c[p[i : i + 3]] += n
        self.by = {}
        return out


class LetterModel:
    """Naive Bayes on letter trigrams, trained on texts whose function words are decisive."""

    REMEMBERED = 200_000

    def __init__(self, texts: Iterable[str]) -> None:
        known = LanguageWords()
        for t in texts:
            known.add(t)
        self._train(known.trigrams())

    @classmethod
    def of(cls, by: dict[str, Counter]) -> LetterModel:
        """The model of counts of trigrams by language."""
        model = cls.__new__(cls)
        model._train(by)
        return model

    def _train(self, by: dict[str, Counter]) -> None:
        by = {k: c for k, c in by.items() if sum(c.values()) >= 200}
        seen = set().union(*by.values()) if by else set()
        self.languages = sorted(by)
        self.logs = {}
        for k, c in by.items():
            total = sum(c.values()) + 0.5 * max(len(seen), 1)
            self.logs[k] = ({g: math.log((n + 0.5) / total) for g, n in c.items()}, math.log(0.5 / total))
        self._words: dict[str, tuple[int, list[float]]] = {}

    def _word(self, w: str) -> tuple[int, list[float]]:
        known = self._words.get(w)
        if known is None:
            if len(self._words) > self.REMEMBERED:
                self._words.clear()
            p = f" {w} "
            grams = [p[i : i + 3] for i in range(len(p) - 2)]
            known = self._words[w] = len(grams), [sum(logs.get(g, low) for g in grams) for logs, low in map(self.logs.__getitem__, self.languages)]
        return known

    def __call__(self, ws: list[str]) -> tuple[str | None, float]:
        """The likeliest language and its lead over the next, a trigram."""
        if len(self.languages) < 2:
            return NO_LANGUAGE
        sizes, own = zip(*map(self._word, ws)) if ws else ((), ())
        n = sum(sizes)
        if n < 24:
            return NO_LANGUAGE
        total = map(sum, zip(*own))
        (first, lang), (second, _) = sorted(zip(total, self.languages), reverse=True)[:2]
        return lang, (first - second) / n


def _without_question(answer: list[str], question: list[str]) -> list[str] | None:
    """What is left of the answer's words without the runs that repeat the question; None if none do."""
    if " ".join(question) not in " ".join(answer):
        return None
    n, out, i, hit = len(question), [], 0, False
    while i < len(answer):
        if n and answer[i : i + n] == question:
            hit, i = True, i + n
        else:
            out.append(answer[i])
            i += 1
    return out if hit else None


def _open_end(last: str, aw: list[str], a: str) -> bool:
    """Something that calls for more: a comma or the like, a word that leads on, an open bracket, a figure broken off."""
    return last.rstrip("*_ ")[-1:] in tuple(",;:([{$€£-–—/&") or bool(aw and aw[-1] in _INDEX) or a.count("(") > a.count(")") or a.count("【") > a.count("】") or a.count("[") > a.count("]")


def _rows_complete(lines: list[str]) -> int:
    """-1 if the last line is a whole row of a table or item of a list, 1 if it is a part of one, 0 if it is neither."""
    last = lines[-1]
    if last.startswith("|"):
        return -1 if last.endswith("|") and (len(lines) < 2 or last.count("|") >= lines[0].count("|")) else 1
    if last[:2] in ("- ", "* ", "• ") and len(lines) > 1 and not FIGURE.search(last) and any(FIGURE.search(x) for x in lines[:-1] if x[:2] == last[:2]):
        return 1
    return -1 if _BARE.match(last) or _LABELLED.match(last) else 0


def votes(question: str | None, answer: str | None, error: str | None, model: LetterModel, wanted: Iterable[str] = DEFECTS) -> dict[str, tuple[int, ...]]:
    """1, 0 or -1 of every labelling function, by wanted defect; see PRIORS for what each looks at."""
    q, a, e = question or "", (answer or "").strip("\ufeff\u200b\u200c\u200d\u2060 \t\r\n\xa0"), (error or "").strip().lower()
    aw, qw = words(a), words(q)
    figure = bool(FIGURE.search(a))
    void = not aw
    stand_in = " ".join(aw) in STAND_INS
    out: dict[str, tuple[int, ...]] = {}
    if "empty" in wanted:
        out["empty"] = (1 if void else -1, 1 if void or stand_in else -1, 1 if e in ("empty_model_answer", "empty answer") else 0, 1 if void or (len(aw) <= 3 and not figure) else -1)

    rest = _without_question(aw, qw) if len(qw) >= 3 else None
    repeated = rest is not None and (not rest or " ".join(rest) in _LABEL or all(w in _LABEL or w in ("you", "asked") for w in rest))
    silent = void or stand_in or repeated
    if "copy" in wanted:
        if not void and len(qw) >= 3:
            said = set(aw) - (_LABELS - set(qw))
            overlap = len(said & set(qw)) / len(said | set(qw))
            asks = a.rstrip("*_\"'”» \n")[-1:] == "?"
            shape = len(a) / len(q)
            out["copy"] = (1 if repeated else -1, 1 if overlap >= 0.85 else -1, 1 if asks and not figure else 0, 0 if 0.7 <= shape <= 3.5 else -1)
        else:
            out["copy"] = (-1, -1, 0, -1)

    stopped = bool(_STOPPED.search(a))
    if "truncated" in wanted:
        if silent:
            out["truncated"] = (-1, 0, 0, 0)
        else:
            lines = [x for x in map(str.strip, a.split("\n")) if x] or [a]
            last = lines[-1]
            closed = stopped and not _CUT_FIGURE.search(a)
            rows = _rows_complete(lines)
            cited = bool(_CITED.search(last)) and a.count("(") == a.count(")") and a.count("[") == a.count("]")
            ends = closed or cited or rows < 0
            out["truncated"] = (0 if rows > 0 and closed else -1 if ends else 1, 1 if not closed and rows >= 0 and _open_end(last, aw, a) else 0, max(rows, 0) if not closed else 0, 1 if not ends and len(answer or "") >= STORED_LENGTH - 2 else 0)

    if "refusal" in wanted:
        if silent:
            out["refusal"] = (-1, 0, 0, -1, 0)
        else:
            out["refusal"] = (1 if REFUSING.search(a.lower()) else -1, -1 if figure else 1, 1 if e == "abstained" else 0, 1 if stopped and len(aw) <= 45 else -1, 1 if stopped and not figure and not SPEAKING.isdisjoint(aw) else 0)

    if "language" in wanted:
        if silent or not qw:
            out["language"] = (-1, 0, 0)
        else:
            ql = language_by_words([*bare_words(q), *(w for w in qw if w in _INDEX)])[0]
            asked = set(qw)
            ws = [w for w in bare_words(a) if w and w not in asked]  # names of fields that the question gives say nothing
            al, lead = language_by_words(ws)
            one = 0 if ql is None or al is None or lead < 1 else (1 if al != ql else -1)
            nl, gap = model(ws) if sum(w in _INDEX for w in ws) >= 2 else NO_LANGUAGE  # labels and names alone say nothing
            two = 0 if ql is None or nl is None or gap < 0.12 else (1 if nl != ql else -1)
            own = LETTERS.get(ql or "", "")
            three = 1 if ql is not None and not a.isascii() and any(c > "\x7f" and c not in own for w in ws for c in w) else 0
            out["language"] = (one, two, three)
    return out


# What is thought of each function before any data: the chances of a vote for, none and against, if the pair
# has the defect and if it has not; the last is the share of pairs with the defect. Each weighs as much as PRIOR_SHARE
# of all pairs, so that the model behaves alike at every size.
PRIOR_SHARE = 0.02
_BOTH = ((0.95, 0.0, 0.05), (0.01, 0.0, 0.99))  # votes either way
_FOR = ((0.5, 0.5, 0.0), (0.01, 0.99, 0.0))  # votes for the defect or is silent
_OFTEN = ((0.98, 0.0, 0.02), (0.3, 0.0, 0.7))  # also fires on many sound pairs
_UNSURE = ((0.9, 0.08, 0.02), (0.02, 0.3, 0.68))  # votes either way, and often not at all
_AGAINST = ((0.0, 0.95, 0.05), (0.0, 0.3, 0.7))  # rules the defect out or is silent
PRIORS: dict[str, tuple[list[tuple[tuple[float, float, float], tuple[float, float, float]]], float]] = {
    # no word at all; a text that stands in for one; the call's error; hardly a word and no figure
    "empty": ([_BOTH, _BOTH, _FOR, _BOTH], 0.04),
    # end of the answer; what stands open; the last row or item; the store's limit
    "truncated": ([_BOTH, _FOR, _FOR, _FOR], 0.04),
    # phrases; no figure; the call's error; short and closed; speaks of itself or the asker
    "refusal": ([((0.9, 0.0, 0.1), (0.1, 0.0, 0.9)), _BOTH, _FOR, _OFTEN, _FOR], 0.04),
    # runs of words; set of words; asks back; length
    "copy": ([_BOTH, _BOTH, _FOR, _AGAINST], 0.03),
    # function words; letters in threes; letters that the question's language hasn't
    "language": ([_UNSURE, _UNSURE, _FOR], 0.04),
}


_SIGNS = {v: "".join("0+-"[x] for x in v) for k in {len(f) for f, _ in PRIORS.values()} for v in itertools.product((1, 0, -1), repeat=k)}


def patterns(question: str | None, answer: str | None, error: str | None, model: LetterModel, wanted: Iterable[str] = DEFECTS) -> dict[str, str]:
    """The votes on each wanted defect, written as one sign a function."""
    return {d: _SIGNS[v] for d, v in votes(question, answer, error, model, wanted).items()}


def _trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = LanguageWords()

    def counted() -> pa.RecordBatch:
        rows = [(lang, g, n) for lang, c in known.trigrams().items() for g, n in c.items()]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["language", "trigram", "n"])

    for b in batches:
        for c in ("question", "model_answer"):
            for t in texts_of(b, c):
                if t:
                    known.add(t)
            if known.full():
                yield counted()
    yield counted()


def _rows(batches: Iterator[pa.RecordBatch], model: LetterModel) -> Iterator[pa.RecordBatch]:
    names = ["result_id", "fold", "question", "model_answer", "own", "size", *DEFECTS]
    for b in batches:
        texts = [texts_of(b, k) for k in ("question", "model_answer", "error")]
        got = [(patterns(*r, model), own_language(r[0] or "", r[1] or "")) for r in zip(*texts)]
        size = [len(q or "") + len(a or "") for q, a in zip(*texts[:2])]
        yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(k)) for k in names[:4]), pa.array([g[1] for g in got], pa.string()), pa.array(size, pa.int64()), *(pa.array([g[0][d] for g in got], pa.string()) for d in DEFECTS)], names=names)


def fit(counts: dict[str, int], defect: str, rounds: int = 100) -> dict[str, float]:
    """Posterior of the defect for each possible vote pattern, by expectation-maximization.

    A function that votes both ways tells nothing by abstaining, so its
    abstentions are left out; for one that only ever votes for a defect,
    silence is its vote against.
    """
    priors, share = PRIORS[defect]
    k = len(priors)
    patterns = ["".join(p) for p in itertools.product("+0-", repeat=k)]
    col = {"+": 0, "0": 1, "-": 2}
    idx = np.array([[col[c] for c in p] for p in patterns])
    n = np.array([counts.get(p, 0) for p in patterns], float)
    prior_rows = max(20.0, PRIOR_SHARE * n.sum())
    belief = np.array(priors, float) + 1e-4  # functions x class x vote
    two_sided = np.array([any(c[2] > 0 for c in f) and any(c[0] > 0 for c in f) for f in priors])
    belief[two_sided, :, 1] = 0
    belief /= belief.sum(axis=2, keepdims=True)
    says = ~(two_sided[None, :] & (idx == 1))  # patterns x functions
    theta, pi = belief.copy(), share
    post = np.zeros(len(patterns))
    for _ in range(rounds):
        like = np.array([np.where(says, np.log(np.maximum(theta[np.arange(k)[None, :], c, idx], 1e-12)), 0.0).sum(axis=1) for c in (0, 1)])
        odds = np.clip(like[1] - like[0] + math.log((1 - pi) / pi), -500, 500)
        new = 1 / (1 + np.exp(odds))
        moved, post = np.abs(new - post).max(), new
        if moved < 1e-9:
            break
        weight = np.array([n * post, n * (1 - post)])
        for f in range(k):
            for c in (0, 1):
                hist = np.bincount(idx[says[:, f], f], weights=weight[c][says[:, f]], minlength=3) + prior_rows * belief[f, c]
                theta[f, c] = hist / hist.sum()
        pi = (weight[0].sum() + prior_rows * share) / (n.sum() + prior_rows)
    return dict(zip(patterns, post.tolist()))


def cutoff(counts: dict[str, int], posterior: dict[str, float]) -> float:
    """The cutoff of at least a half with the best expected F1 on pairs held out from the fit."""
    best, at = -1.0, 0.5
    total = sum(n * posterior[p] for p, n in counts.items())
    for cut in [x / 20 for x in range(10, 20)]:
        kept = [(n, posterior[p]) for p, n in counts.items() if posterior[p] >= cut]
        hits, size = sum(n * x for n, x in kept), sum(n for n, _ in kept)
        f1 = 2 * hits / (size + total) if size + total else 0.0
        if f1 > best + 1e-12:
            best, at = f1, cut
    return at


# Answers by which a defect is put into a sound pair; the last two need the pair itself.
_VOID = ("", "\n", "N/A", "**Answer:**", "```\n```", "null", "(no content)", "...")
_REFUSALS = ("I'm sorry, but I can't answer that.", "The documents don't let me answer this question.", "Leider kann ich diese Frage nicht beantworten.", "Je ne peux pas répondre à cette question.", "No puedo responder a esa pregunta.")


def with_defect(defect: str, k: int, question: str, answer: str, others: dict[str, list[str]]) -> str | None:
    """The answer with a defect of the given type put in; None if this pair can't have it. k varies the form."""
    if defect == "empty":
        return _VOID[k % len(_VOID)]
    if defect == "refusal":
        return _REFUSALS[k % len(_REFUSALS)]
    if defect == "copy":
        return (question, f"**Question:** {question}", question.lower(), question.upper(), f"{question}\n\n{question}")[k % 5]
    if defect == "truncated":
        spans = [m.start() for m in re.finditer(r"(?<=[a-zäöüßéèáíóúñ]) (?=[a-zäöüßéèáíóúñ])", answer)]
        return answer[: spans[k % len(spans)]] if spans else None
    own = language_by_words(bare_words(question))[0]
    foreign = sorted(x for x in others if x != own)
    return others[pick][k % len(others[pick])] if own and foreign and others[pick := foreign[k % len(foreign)]] else None


def tested(pairs: Iterable[tuple[str, str, str | None, int, dict[str, str]]], posteriors: list[dict[str, dict[str, float]]], model: LetterModel) -> Counter:
    """Counts of (fold, defect, made, pattern): each pair that its fold's posteriors call sound, and the same pair with one defect put in.

    pairs: question, answer, own language, fold and the patterns of its votes. The defects take turns.
    """
    sound = [r for r in pairs if all(posteriors[r[3]][d][x] < 0.5 for d, x in r[4].items())]
    others: dict[str, list[str]] = {}
    for _, a, lang, _, _ in sound:
        if lang:
            others.setdefault(lang, []).append(a)
    out: Counter = Counter()
    for k, (q, a, _, f, p) in enumerate(sound):
        d = DEFECTS[k % len(DEFECTS)]
        made = with_defect(d, k // len(DEFECTS), q, a, others)
        if made is not None:
            out[f, d, True, patterns(q, made, None, model, (d,))[d]] += 1
        out.update((f, o, False, x) for o, x in p.items())
    return out


def cutoffs(counts: Iterable[tuple[str, bool, float, int]]) -> dict[str, float]:
    """The cutoff of each defect with the best F1 on pairs without and with the defect put in; the middle of the best ones.

    counts: defect, whether it was put in, posterior and number of pairs.
    """
    rows = list(counts)
    out = {}
    for d in DEFECTS:
        true, false = ([(x, n) for o, m, x, n in rows if o == d and m == made] for made in (True, False))
        total = sum(n for _, n in true)
        f1 = {}
        for cut in (x / 20 for x in range(6, 20)):
            hit, wrong = sum(n for x, n in true if x >= cut), sum(n for x, n in false if x >= cut)
            f1[cut] = 2 * hit / (hit + wrong + total) if total else 0.0
        best = [c for c in f1 if f1[c] >= max(f1.values()) - 1e-12]
        out[d] = best[len(best) // 2] if total else 0.5
    return out


def validated(pairs: list[tuple[str, str]], posterior: dict[str, dict[str, float]], model: LetterModel) -> dict[str, float]:
    """The cutoffs by pairs that no posterior was fitted on."""
    counts = tested([(q, a, own_language(q, a), 0, patterns(q, a, None, model)) for q, a in pairs], [posterior], model)
    return cutoffs((d, made, posterior[d][p], n) for (_, d, made, p), n in counts.items())


def _tested(group: pa.Table, posteriors: list[dict[str, dict[str, float]]], model: LetterModel) -> pa.Table:
    group = group.sort_by("result_id")
    q, a, own, fold, *signs = (group.column(k).to_pylist() for k in ("question", "model_answer", "own", "fold", *DEFECTS))
    counts = tested(zip(q, a, own, fold, (dict(zip(DEFECTS, p)) for p in zip(*signs))), posteriors, model)
    out = [(*k, n) for k, n in counts.items()]
    return pa.table([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int32(), pa.string(), pa.bool_(), pa.string(), pa.int64()))], names=["fold", "defect", "made", "pattern", "n"])


def once_each(pairs: DataFrame) -> DataFrame:
    """One row an id. The texts are shuffled only if the ids, counted first, repeat."""
    if pairs.groupBy("result_id").count().where("count > 1").isEmpty():
        return pairs
    least = pairs.groupBy("result_id").agg(F.min(F.struct("question", "model_answer", "error")).alias("r"))
    return materialize(least.select("result_id", "r.*"), "p2-pairs")


def letter_model(pairs: DataFrame) -> LetterModel:
    """The letter model of all questions and answers."""
    by: dict[str, Counter] = {}
    for r in pairs.select("question", "model_answer").mapInArrow(_trigrams, "language string, trigram string, n long").groupBy("language", "trigram").agg(F.sum("n").alias("n")).collect():  # trigrams that the texts' alphabets form, whatever the number of rows
        by.setdefault(r.language, Counter())[r.trigram] = r.n
    return LetterModel.of(by)


def voted_on(pairs: DataFrame, model: LetterModel) -> DataFrame:
    """result_id, fold, question, model_answer, their own language, size in characters and the pattern of votes on each defect, of pairs with unique ids."""
    fold = F.pmod(F.xxhash64("result_id"), F.lit(FOLDS)).cast("int")
    return pairs.select("result_id", fold.alias("fold"), "question", "model_answer", "error").mapInArrow(partial(_rows, model=model), "result_id long, fold int, question string, model_answer string, own string, size long, " + ", ".join(f"`{d}` string" for d in DEFECTS))


def pattern_counts(voted: DataFrame) -> DataFrame:
    """fold, defect, pattern, n: how often each pattern of votes stands."""
    combined = voted.groupBy("fold", *DEFECTS).count()
    each = combined.select("fold", "count", F.explode(F.array(*[F.struct(F.lit(d).alias("defect"), F.col(d).alias("pattern")) for d in DEFECTS])).alias("x"))
    return each.groupBy("fold", "x.defect", "x.pattern").agg(F.sum("count").alias("n"))


def counts_of_tests(voted: DataFrame, posteriors: list[dict[str, dict[str, float]]], model: LetterModel) -> DataFrame:
    """fold, defect, made, pattern, n: the counts of `tested` over all pairs, which fall into groups by their ids."""
    r = voted.agg(F.count("*").alias("rows"), F.sum("size").alias("size")).first()
    groups = 1 + max(r.rows // GROUP_ROWS, (r["size"] or 0) // GROUP_CHARS)
    both = voted.where("question is not null and model_answer is not null").withColumn("part", F.pmod(F.xxhash64(F.lit("part"), "result_id"), F.lit(groups)))
    counts = both.groupBy("part").applyInArrow(lambda t: _tested(t, posteriors, model), "fold int, defect string, made boolean, pattern string, n long")
    return counts.groupBy("fold", "defect", "made", "pattern").agg(F.sum("n").alias("n"))


def labelled(results: DataFrame) -> DataFrame:
    """result_id, defect, posterior: every defect of a pair whose posterior reaches its cutoff.

    results: result_id, question, model_answer, error. A null answer is empty;
    a null question leaves only empty, truncated and refusal possible. Rows
    without an id are left out; a repeated row counts once, and of rows that
    differ under one id the smallest counts.
    """
    pairs = once_each(results.select("result_id", "question", "model_answer", "error").where("result_id is not null"))
    model = letter_model(pairs)
    voted = materialize(voted_on(pairs, model), "p2-votes")
    counted = pattern_counts(voted).collect()  # at most FOLDS x 5 x 243 rows
    of = lambda d, without=None: dict(sum((Counter({r.pattern: r.n}) for r in counted if r.defect == d and r.fold != without), Counter()))
    posteriors = [{d: fit(of(d, f), d) for d in DEFECTS} for f in range(FOLDS)]
    cuts = cutoffs((r.defect, r.made, posteriors[r.fold][r.defect][r.pattern], r.n) for r in counts_of_tests(voted, posteriors, model).collect())  # at most FOLDS x 5 x 2 x 243 rows
    table = [(d, p, round(x, 6)) for d in DEFECTS for p, x in fit(of(d), d).items() if x >= cuts[d]]  # at most 5 x 243 rows
    kept = results.sparkSession.createDataFrame(table, "defect string, pattern string, posterior double")
    each = voted.select("result_id", F.explode(F.array(*[F.struct(F.lit(d).alias("defect"), F.col(d).alias("pattern")) for d in DEFECTS])).alias("x")).select("result_id", "x.*")
    return each.join(F.broadcast(kept), ["defect", "pattern"]).select("result_id", "defect", "posterior")


def found(results: DataFrame) -> DataFrame:
    """result_id, defect: as no pair has two defects, the label with the highest posterior; ties go by name."""
    return labelled(results).groupBy("result_id").agg(F.min_by("defect", F.struct(-F.col("posterior"), "defect")).alias("defect"))
