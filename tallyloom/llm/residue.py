"""Problem 8: template residue, filler, error pages and script notices.

Method: message templates are mined with a prefix tree of fixed depth, each is
classified once, and its verdict goes to all lines of the template.

A message's path in the tree is its number of words and its first DEPTH words,
numbers being wildcards. Below it, a template keeps the words that decide
(those that any rule looks at) and has wildcards for all others, so that no
wildcard covers what a verdict depends on. A template is thus a function of
its message: trees of different tasks need no merging beyond adding counts,
and neither the order nor the partitioning of the records matters.

Two kinds of evidence give a template its verdict. The words that it keeps are
read by rules (`classify`). And over the whole corpus it is counted how many
records hold the template, in how many it stands alone but for navigation and
titles, and in how many it is repeated word for word: sentences of real texts
stand among others and are not repeated, messages of a server stand alone, and
stand-in copy is repeated. Templates with such a verdict, a small table, are
joined back to the records. Unresolved slots are looked for separately in
every text, as they stand inside ordinary records.

An error page or a script notice is a record whose lines are all such
messages, navigation or titles; one ordinary line makes it a document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from re import _parser

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm._shared import maybe_broadcast, slices, texts_of
from tallyloom.session import materialize

KINDS = ("placeholder", "filler", "error_page", "script_notice")
#: Templates and units that a task remembers before it starts anew; verdicts are functions of the line, so nothing changes.
REMEMBERED = 400_000
#: Lines of more words are paragraphs, not messages: they are looked at sentence by sentence.
LONG_LINE = 40
#: Words of a message that name the path in the prefix tree, below the number of its words.
DEPTH = 3
#: A mined template is a verdict of its own if at least so many records hold it ...
LEAST_RECORDS = 3
#: ... and it stands (nearly) alone in this share of them, with navigation in one of them: a notice;
ALONE_SHARE = 0.8
#: ... or it is repeated word for word within this share of them: filler.
REPEATED_SHARE = 0.25
BROADCAST_ROWS = 200_000
#: Stands for a word that decides nothing.
WILD = "qx"

# Markup tags and entities, which are no slots.
_TAGS = "a b i p u br hr h1 h2 h3 h4 h5 h6 ul ol li td th tr div pre sub sup span code font body head html meta link table thead tbody title script style noscript form input img em strong small center blockquote xbrl error key message resource section article header footer nav main sec document type sequence filename description text"
_ENTITIES = "amp nbsp lt gt quot apos copy reg trade euro pound yen cent sect para middot bull hellip ndash mdash lsquo rsquo ldquo rdquo laquo raquo deg plusmn times divide frac12 shy ensp emsp thinsp zwnj zwj"
_NOT_SLOTS = "brackets unaudited audited sic restated note page signed seal logo table figure chart exhibit annex schedule applause laughter inaudible crosstalk"
_TAG = rf"(?!/?(?:{'|'.join(_TAGS.split())})\b)"
_ENTITY = rf"(?!(?:{'|'.join(_ENTITIES.split())});)"
_PLAIN = rf"(?!(?:{'|'.join(_NOT_SLOTS.split())})\b)"
_NAME = r"[A-Za-z][A-Za-z0-9_]*(?:[ .][A-Za-z0-9_]+){0,3}"
#: Slots of the usual template languages, fill-in notes, and blanks; bounded by the line and their closing mark.
SLOT = re.compile(
    "|".join(
        (
            r"\{\{[^{}\n]*\}\}",
            r"\{%[^{}\n]+%\}",
            r"\[\[\s*[A-Za-z_][\w .]*+\s*+\]\]",
            r"<%[^<>\n]*%>",
            r"[$#]\{\s*[A-Za-z_][^{}\n]*\}",
            r"\{![^{}\n]+\}",
            r"\{\s*(?:\d{1,2}|[a-z]+(?:_[a-z]+)*)\s*\}",
            r"\{\s*[A-Z]+(?:_[A-Z]+)*\s*\}",
            rf"<<\s*{_NAME}\s*>>",
            r"<(?i:enter|insert|your|fill in|add|type) [^<>\n]+>",
            rf"<(?i:{_TAG})[A-Z]{{3,}}(?:[_ ][A-Z]+)*>",
            rf"<(?i:{_TAG})[a-z]+(?:_[a-z]+)+>",
            r"(?<![\w%])%[A-Z]{2,}(?:_[A-Z]+)*%(?!\w)",
            r"(?<![\w%])%[a-z]+(?:_[a-z]+)+%(?!\w)",
            r"__[A-Za-z]+(?:_[A-Za-z]+)*__",
            r"_{4,}",
            r"\$\$[A-Za-z]+(?:_[A-Za-z]+)*\$\$",
            r"@@[A-Za-z]+(?:_[A-Za-z]+)*@@",
            r"##[A-Za-z]+(?:_[A-Za-z]+)*##",
            r"«[a-z]+(?:[ _][a-z]+){0,3}»",
            rf"&(?i:{_ENTITY})[A-Z]{{3,}}(?:_[A-Z]+)*;",
            r"\[\s*(?:[•●◦_…]|\*{2,}|\.{3,}|_{2,})\s*\]",
            r"\[\s?\]",
            r"[\[(](?i:insert|enter|fill in|add|type|choose|select) [^\[\]()\n]+[\])]",
            r"\[(?i:your|name of|date of|amount of) [^\[\]\n]+\]",
            r"\[[^\[\]\n]*\b(?:TBC|TBD|TBA|here|to come|to be (?:completed|confirmed|inserted|provided))\]",
            rf"(?<![A-Z] )\[(?i:{_PLAIN})[A-Z]{{3,}}(?:[ _][A-Z]{{2,}}){{0,3}}\](?! [A-Z]{{2}})",
            r"(?<![\w.,])X{1,3}[.,]X{1,3}\s?%",
            r"(?<![\w.,])XX\s?%",
            r"[$€£]\s?X+(?:,X{3})*(?:\.X+)?(?![A-Za-z])",
        )
    )
)
# Words of filler Latin, with the variants in which they are garbled.
LOREM = frozenset("lorem ipsum dolor dolore dolorem sit amet consectetur consectur adipiscing adipisicing elit sed sedo eiusmod tempor tempora incididunt ut labore laboris et magna aliqua aliquip enim ad minim veniam quis nostrud nostra exercitation ullamco ullam nisi ex ea commodo commoda consequat duis aute irure irura in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur pariat excepteur sint occaecat cupidatat cupida non proident ident sunt culpa qui officia deserunt mollit anim id est laborum".split())
_FILLER = re.compile(
    r"lorem ipsum|^\W*\[? ?(?:body|dummy|sample|placeholder|your|filler) (?:text|copy|content|paragraph)(?: here)?\W*$|\b(?:text|copy|content|paragraph|title|heading|headline|caption)s? (?:goes|go|to go|will go|comes|belongs) (?:here|in this)|\bgoes in this (?:box|space|place|section)|\bwill appear (?:here|in this (?:place|space|section|box))|\b(?:dummy|placeholder|filler|sample) (?:text|copy|paragraph|content)\b.*\b(?:only|layout|here|purposes?|replace)|\bfor layout purposes\b|stands? in for (?:the )?(?:final|real)|\b(?:write|put|type|add|insert) (?:\w+ ){0,6}(?:lines?|text|words|copy|sentences?|paragraphs?|something)\b.*\bhere\b|\bblindtext\b|hier (?:steht|folgt|kommt) (?:bald|demnächst|später|noch)|platzhalter|texto de relleno|texte? (?:de remplissage|fictif|bidon)|faux[- ]texte|ici (?:viendra|figurera)|aquí (?:va|irá) (?:el|un) texto|content coming soon|text coming soon",
    re.I,
)
_KEYS = re.compile(r"^(?:asdf|qwer\w*|jkl\w*|sdfg|zxcv\w*|hjkl|uiop|yxcv|dfgh|fghj|[a-z]?foo|bar|baz|test|testing|xxx+|bla+|blah|tbd|dummy|abc|\W+)$")
_SCRIPT = re.compile(
    r"java ?script|\bjs (?:is|must|needs)|<noscript|\bscripting\b|\bskript\w*|\bscripts?\b(?=.*\b(?:enabl\w+|allow\w*|permit\w*|turn\w*|switch\w*|run|running|need\w*|requir\w*|block\w*|activ\w+|disabled|off|on)\b)|\b(?:enabl\w+|allow\w*|permit\w*|turn\w*|switch\w*|run|needs?|requir\w*|activ\w+|necesita|exige)\b.*\bscripts?\b",
    re.I,
)
_ERROR = re.compile(
    r"\b(?:http|error|status|code|fehler|erreur|código|codigo|errore)\W{0,4}[45]\d\d\b|\((?:fehler |error |erreur )?[45]\d\d\)\W*$|\b(?:page|document|file|report|filing|object|resource|url)\b.{0,40}\b(?:not (?:be )?found|missing|could not be (?:found|loaded|opened)|cannot be (?:found|displayed|loaded)|no longer (?:exists|available)|has moved|does not exist|is gone)|no longer exists|not found\W*$|forbidden|access (?:is |was )?denied\W*(?:you|$)|do not have (?:permission|access)|permission denied|temporarily unavailable|service unavailable|(?:down|closed|offline) for maintenance|under maintenance|bad gateway|gateway time-?out|bad request|unauthori[sz]ed|request time-?d? ?out|timeout after|upstream (?:request|server)|internal server error|server error|something went wrong|\boops\b|database connection|query failed|relation \S+ does not exist|exception in thread|null ?pointer|stack ?trace|traceback \(|^\s*file \S+, line|^\s*\w*(?:error|exception): |<error>|nosuch(?:object|key|bucket)|checksum mismatch|too many requests|rate limit|(?:address|ip|account) has been (?:limited|blocked|suspended)|connection (?:was|has been) (?:reset|refused|closed|lost)|connection (?:reset|refused|timed out)|(?:link|session|token) (?:has )?expired|sign in again|not available in your (?:region|country)|\bsorry\b.{0,40}\bnot available|come back later|try again (?:later|in )|\"status\": ?[45]\d\d|core dumped|segmentation fault|out of memory|dns (?:error|lookup)|certificate (?:has )?expired"
    r"|nicht gefunden|existiert nicht|konnte nicht (?:geladen|gefunden|geöffnet)|nicht (?:verfügbar|erreichbar)|zugriff verweigert|wartungsarbeiten|introuvable|indisponible|n'existe (?:plus|pas)|accès (?:refusé|interdit)|n'a pas pu être|no encontrad[oa]|no disponible|acceso denegado|no se (?:pudo|ha podido)|non trovat[oa]|não encontrad[oa]",
    re.I,
)
_PAYLOAD = re.compile(r'"(?:status|code)": ?"?[45]\d\d\b')
_QUOTED = re.compile(r'["“„«]([^"“”„«»\n]{1,80})["”»“]')
_MENU = frozenset("home filings alerts help skip to main content back search menu reports contact about us login log in sign up register top print email share next previous archive news investors careers privacy terms cookies sitemap imprint navigation close open subscribe support faq language english deutsch français español startseite suche kontakt hilfe impressum accueil recherche inicio buscar contacto ayuda of the and".split())
_LINES = re.compile("[\r\n\x0b\x0c\u2028\u2029]+")
_SENTENCES = re.compile(r"(?<=[.!?…])\s+")
_WORD = re.compile(r"[^\W_]+")


_STATUS = re.compile(r"\b[45]\d\d\b")
_CODES = [(_parser.LITERAL, ord("4")), (_parser.LITERAL, ord("5"))]
#: Letters that patterns without case take for others, though lower case keeps them.
_FOLD = str.maketrans({"ı": "i", "ſ": "s", "\u0307": None})


def _required(items) -> set[str] | None:
    """Literals one of which stands in whatever the parsed pattern matches, as long ones as there are; None if there is none."""
    options, run = [], ""
    for op, arg in [*items, (None, None)]:
        if op is _parser.LITERAL:
            run += chr(arg).lower()
            continue
        if run:
            options.append({run})
            run = ""
        if op is _parser.SUBPATTERN:
            options.append(_required(arg[3]))
        elif op is _parser.BRANCH:
            each = [_required(b) for b in arg[1]]
            options.append(set().union(*each) if all(each) else None)
        elif op in (_parser.MAX_REPEAT, _parser.MIN_REPEAT) and arg[0] > 0:
            options.append(_required(arg[2]))
    return max(filter(None, options), key=lambda o: (min(map(len, o)), -len(o)), default=None)


def branches(pattern: re.Pattern) -> list:
    """The alternatives of a pattern, parsed."""
    parsed = _parser.parse(pattern.pattern, pattern.flags & re.I)
    return parsed[0][1][1] if len(parsed) == 1 and parsed[0][0] is _parser.BRANCH else [parsed]


def marks(pattern: re.Pattern) -> tuple[str, ...]:
    """Literals one of which stands in every line, in lower case, that the pattern matches, so other lines need no search.

    A branch without a literal of three letters is left out if a status code
    is all it asks for; that is looked for separately.
    """
    found: set[str] = set()
    for b in branches(pattern):
        own = _required(b)
        if not own or min(map(len, own)) < 3:
            if not any(op is _parser.IN and arg == _CODES for op, arg in b):
                raise ValueError(f"no mark for {b}")
            continue
        found |= own
    return tuple(sorted(m for m in found if not any(o in m for o in found if o != m)))


_LATIN_MARKS = ("dolor", "ipsum", "lorem", "velit", "cillum", "nulla", "sint ", "aliqu", "magna", "labor", "amet", "elit", "veniam", "mollit", "nisi", "irur", "culpa", "anim ", "fugiat", "tempor", "conse", "quis", "officia", "ullam", "aute ", "duis", "commod", "nostr", "ident", "paria", "cupida")
_FILLER_MARKS, _SCRIPT_MARKS, _ERROR_MARKS = marks(_FILLER), marks(_SCRIPT), marks(_ERROR)
_MONEY = re.compile(r"[$€£]\s?\d")


#: A slot starts where this matches; the pattern is tried nowhere else.
_TRIGGER = re.compile(r"[{\[<«]|&(?=[A-Za-z])|\$(?=[$X{]|\sX)|[€£](?=\s?X)|#(?=[{#])|@(?=@)|_(?=_)|%(?=[A-Za-z])|X(?=[X.,])|\((?=[iefatcsIEFATCS])")


def has_slot(text: str) -> bool:
    """Whether any slot is left unfilled."""
    return any(SLOT.match(text, m.start()) for m in _TRIGGER.finditer(text))


def classify(line: str) -> str:
    """filler, script_notice, error_page, menu, title or text, for one line or template."""
    low = lowered(line)
    ws = _WORD.findall(low)
    if not ws:
        return "title"
    if _is_filler(line, low, ws):
        return "filler"
    if len(ws) > LONG_LINE:
        return "text"
    if all(w in _MENU for w in ws) and len(ws) <= 12:
        return "menu"
    script, error = any(m in low for m in _SCRIPT_MARKS), any(m in low for m in _ERROR_MARKS) or _STATUS.search(low)
    if (script or error) and not _MONEY.search(line):  # a line with amounts reports on something
        quotes = line.lstrip()[:1] not in "{<" and re.search(r"\w \W?[\"“„«]", line) and not re.match(r"\W*(?:file|query|exception|\w*error)\b", line, re.I)
        own = _QUOTED.sub(" ", line) if quotes else line
        if script and _SCRIPT.search(own):
            return "script_notice"
        if error and (_ERROR.search(own) or _PAYLOAD.search(line)):
            return "error_page"
    if low.lstrip().startswith(("(c) ", "© ", "&copy;")) and len(ws) <= 8:
        return "menu"
    return "text" if sum(not w.isdigit() for w in ws) >= 4 else "title"


def _is_filler(line: str, low: str, ws: list[str]) -> bool:
    if any(m in low for m in _FILLER_MARKS) and _FILLER.search(line):
        return True
    if len(ws) < 4:
        return False
    if any(m in low for m in _LATIN_MARKS) and sum(w in LOREM for w in ws) >= 0.6 * len(ws) and sum(w in LOREM and len(w) > 3 for w in ws) >= 3:
        return True
    kinds = len(set(ws))
    if kinds <= max(6, len(ws) // 2) and all(map(_KEYS.match, ws)) or kinds == 1 and len(ws) >= 8 and ws[0] != WILD:
        return True
    return len(ws[0]) >= 2 and len(set(ws[0])) == 1 and all(len(set(w)) == 1 and w.isalpha() and len(w) >= 2 for w in ws)


def _literals() -> tuple[frozenset[str], tuple[str, ...]]:
    """Words that a rule looks at, and their longer literals, which may also stand inside a word."""
    found: set[str] = set()

    def walk(items) -> None:
        run = ""
        for op, arg in [*items, (None, None)]:
            if op is _parser.LITERAL and chr(arg).isalpha():
                run += chr(arg).lower()
                continue
            if run:
                found.add(run)
                run = ""
            if op is _parser.SUBPATTERN:
                walk(arg[3])
            elif op is _parser.BRANCH:
                for b in arg[1]:
                    walk(b)
            elif op in (_parser.MAX_REPEAT, _parser.MIN_REPEAT):
                walk(arg[2])
            elif op is _parser.ASSERT:
                walk(arg[1])

    for p in (_FILLER, _SCRIPT, _ERROR, _PAYLOAD, _KEYS):
        walk(_parser.parse(p.pattern, p.flags & re.I))
    return frozenset(found) | _MENU | LOREM, tuple(sorted({w for w in found if len(w) >= 3} | {m.strip() for m in _LATIN_MARKS}))


_DECIDING, _INSIDE = _literals()
_CORE = re.compile(r"^(\W*)(.*?)(\W*)$", re.S)


class TemplateTree:
    """A prefix tree of message templates: number of words, the first DEPTH words, then the template with its verdict.

    Words that decide nothing are wildcards; see the module's text.
    """

    #: Wildcards; numbers that may be status codes have two of their own, by length.
    WORD, NUMBER, CODE, LONG_CODE = WILD, "0", "404", "4040"

    def __init__(self) -> None:
        self.root: dict[int, dict] = {}
        self.size = 0
        self._masks: dict[str, str] = {}

    def _mask(self, token: str) -> str:
        known = self._masks.get(token)
        if known is None:
            if len(self._masks) > REMEMBERED:
                self._masks.clear()
            before, core, after = _CORE.match(token).groups()
            if core in _DECIDING or len(set(core)) == 1 and core.isalpha() or any(x in core for x in _INSIDE):
                known = token
            elif core.isdigit():
                known = before + (self.NUMBER if core[0] not in "45" or len(core) < 3 else self.CODE if len(core) == 3 else self.LONG_CODE) + after
            elif _STATUS.search(core):
                known = token
            else:
                known = before + (self.NUMBER if core[:1].isdigit() else self.WORD if core else "") + after
            self._masks[token] = known
        return known

    def template(self, line: str) -> str:
        """The line in lower case with its wildcards."""
        low = lowered(line)
        return " ".join(map(self._mask, low.split()))

    def verdict(self, line: str) -> str:
        template = self.template(line)
        if not any(map(str.isalpha, template)):  # numbers only: which are equal may decide
            return classify(line)
        tokens = template.split(" ")
        node = self.root.setdefault(len(tokens), {})
        for w in tokens[:DEPTH]:
            node = node.setdefault(w, {})
        known = node.get(template)
        if known is None:
            if self.size > REMEMBERED:
                self.root.clear()
                self.size = 0
            known = node[template] = classify(template)
            self.size += 1
        return known


@cache
def _automaton():
    """Finds the marks of all rules in one pass over a text: 1 error, 2 script, 4 filler, 8 filler Latin."""
    import ahocorasick

    bits: dict[str, int] = {}
    for bit, own in ((1, (*_ERROR_MARKS, '"status"', '"code"')), (2, _SCRIPT_MARKS), (4, _FILLER_MARKS), (8, _LATIN_MARKS)):
        for m in own:
            bits[m] = bits.get(m, 0) | bit
    a = ahocorasick.Automaton()
    for m, bit in bits.items():
        a.add_word(m, bit)
    a.make_automaton()
    return a


_LINE = re.compile("[^\r\n\x0b\x0c\u2028\u2029]+")
_CODE_LAST = re.compile(r"\(\D*[45]\d\d\)\W*$")
_BLANK = " \t\ufeff\u200b"


def lines_of(low: str) -> Iterator[tuple[str, int, int]]:
    """Lines of a text in lower case, the marks that stand in each, and the number of those of filler Latin."""
    hits, end, bit = _automaton().iter(low), -1, 0
    for m in _LINE.finditer(low):
        found = latin = 0
        while end < m.end():
            if end >= m.start():
                found |= bit
                latin += bit == 8
            end, bit = next(hits, (len(low) + 1, 0))
        line = m.group().strip().strip(_BLANK)
        if line:
            if ")" in line[-8:] and _CODE_LAST.search(line):
                found |= 1
            yield line, found, latin


def borders(tokens: list[str]) -> list[int]:
    """For each prefix the length of its longest proper border (a prefix that is also its suffix); linear in the tokens."""
    out = [0] * len(tokens)
    k = 0
    for i in range(1, len(tokens)):
        while k and tokens[i] != tokens[k]:
            k = out[k - 1]
        k += tokens[i] == tokens[k]
        out[i] = k
    return out


def period_of(tokens: list[str]) -> int:
    """Number of words after which a message repeats itself word for word (at least half of it again); its length if it doesn't."""
    n = len(tokens)
    while tokens.count(tokens[0]) > 1:
        p = n - borders(tokens)[-1]
        if p < 2 or 3 * p > 2 * n:
            break
        tokens, n = tokens[:p], p
    return n


def repeated_tail(tokens: list[str]) -> int:
    """Number of words at the end that repeat three words or more, word for word, after something else; 0 if none do."""
    n = len(tokens)
    if n < 7 or tokens.count(tokens[-1]) < 2:
        return 0
    best = 0
    for i, k in enumerate(borders(tokens[::-1])):
        p = i + 1 - k
        if p >= 3 and i + 1 >= 2 * p and i + 1 < n and any(t.isalpha() for t in tokens[n - p :]):
            best = (i + 1) // p * p
    return best


def _few_words(tokens: list[str], least: int = 4) -> bool:
    """Whether fewer than `least` tokens are free of digits."""
    n = 0
    for t in tokens:
        if t.isalpha() or not any(map(str.isdigit, t)):
            n += 1
            if n == least:
                return False
    return True


def lowered(text: str) -> str:
    """Lower case, with the letters that patterns without case take for others."""
    low = text.lower()
    return low if low.isascii() or not any(c in low for c in "ıſ\u0307") else low.translate(_FOLD)


class Reader:
    """What one record's text says by itself, and the units whose templates are counted over all records."""

    def __init__(self) -> None:
        self.tree = TemplateTree()
        self.seen: dict[str, str] = {}

    def line_verdict(self, line: str, found: int, latin: int) -> str:
        """`classify` by template; rules are tried only where a mark or the first word calls for it."""
        first, last = line.split(None, 1)[0].strip(_EDGES), line.rsplit(None, 1)[-1].strip(_EDGES)
        if found & 7 or latin >= 3 or first == last or len(set(first)) <= 1 or _KEYS.match(first):
            known = self.seen.get(line)
            if known is None:
                if len(self.seen) > REMEMBERED:
                    self.seen.clear()
                known = self.seen[line] = self.tree.verdict(line)
            return known
        if line.count(" ") >= 24:
            return "text"
        ws = _WORD.findall(line)
        if all(w in _MENU for w in ws) and 0 < len(ws) <= 12 or line.startswith(("(c) ", "© ", "&copy;")) and len(ws) <= 8:
            return "menu"
        return "text" if sum(not w.isdigit() for w in ws) >= 4 else "title"

    def read(self, text: str) -> tuple[bool, int, int, bool, bool, dict[int, int]]:
        """filler, error lines, script lines, alone, navigation, and units: template id with bits 1 repeated, 2 speaks of scripts."""
        low = lowered(text)
        filler, error, script, titles, menu = False, 0, 0, 0, False
        times: dict[str, int] = {}
        speaks: set[str] = set()
        for line, found, latin in lines_of(low):
            long = len(line) > 4 * LONG_LINE and line.count(" ") >= LONG_LINE
            v = "text" if long else self.line_verdict(line, found, latin)
            if v == "filler":
                filler = True
            elif v == "error_page":
                error += 1
            elif v == "script_notice":
                script += 1
            elif v == "menu":
                menu = True
            elif v == "title":
                titles += 1
            else:
                for s in _SENTENCES.split(line):
                    if s:
                        if long and (found & 7 or latin >= 3) and len(s) < len(line) and self.tree.verdict(s) == "filler":
                            filler = True
                        times[s] = times.get(s, 0) + 1
                        if found & 2 and any(m in s for m in _SCRIPT_MARKS):
                            speaks.add(s)
        units: dict[int, int] = {}
        for s, n in times.items():
            tokens = s.split()
            a, b = 0, len(tokens)
            while a < b and tokens[a].strip("|") in _CHROME:
                a += 1
            while b > a and tokens[b - 1].strip("|") in _CHROME:
                b -= 1
            if b - a < 3:
                a, b = 0, len(tokens)
            menu |= b - a < len(tokens) and any(t in tokens for t in ("|", "skip", "search", "menu", "contact", "help"))
            split = b - repeated_tail(tokens[a:b])
            for part in filter(None, (tokens[a:split], tokens[split:b])):
                size = period_of(part)
                again = n > 1 or size < len(part)
                if not again and _few_words(part):
                    titles += 1
                    continue
                own = ["0" if any(map(str.isdigit, t)) else t for t in part[: min(size, DEPTH)]]
                key = xxhash.xxh3_64_intdigest(f"{size} {' '.join(own)}") & ~7
                units[key] = units.get(key, 0) | again | (2 if s in speaks else 0)
        return filler, error, script, len(units) <= 2 and titles <= 2, menu, units


_EDGES = ".,;:|[]()*"
#: Words of navigation that may be joined to a message's first or last line.
_CHROME = _MENU | {""}


def kind_of(text: str | None, tree: TemplateTree | None = None) -> str | None:
    """The kind of one record by itself, without what the corpus says about its templates."""
    if not text or not text.strip():
        return None
    if has_slot(text):
        return "placeholder"
    reader = Reader()
    reader.tree = tree or reader.tree
    filler, error, script, _, _, units = reader.read(text)
    if filler:
        return "filler"
    if units or not error + script:
        return None
    return "script_notice" if script >= error else "error_page"


_FEATURES = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("slot", pa.bool_()), ("filler", pa.bool_()), ("error", pa.int32()), ("script", pa.int32()), ("alone", pa.bool_()), ("menu", pa.bool_()), ("units", pa.list_(pa.int64()))])
_DDL = "doc_id long, text_hash long, slot boolean, filler boolean, error int, script int, alone boolean, menu boolean, units array<long>"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    reader = Reader()
    for b in slices(batches, "text"):
        rows = []
        for i, t in zip(b.column(0).to_pylist(), texts_of(b, "text")):
            if t.strip():
                *first, units = reader.read(t)
                rows.append((i, np.uint64(xxhash.xxh3_64_intdigest(t)).view(np.int64), has_slot(t), *first, np.array([k | f for k, f in units.items()], np.uint64).view(np.int64)))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _FEATURES)], schema=_FEATURES)


def _bit(c: str, bit: int) -> Column:
    return F.col(c).bitwiseAND(F.lit(bit).cast("long")) > 0


def read_records(documents: DataFrame) -> DataFrame:
    """One row a record: what its text says by itself, and its units."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    return materialize(rows.mapInArrow(_read, _DDL), "p8-records")


def mined_templates(records: DataFrame) -> DataFrame:
    """template, records, alone, repeated, kind: the templates whose verdict comes from how they stand in the corpus.

    A notice that stands alone needs records of different texts, so that one
    short text under several ids is none.
    """
    u = records.select(F.explode("units").alias("u"), "alone", "menu", "text_hash")
    one = F.lit(1)
    t = u.groupBy(F.col("u").bitwiseAND(F.lit(-8).cast("long")).alias("template")).agg(
        F.count(one).alias("records"), F.count_if("alone").alias("alone"), F.count_if(_bit("u", 1)).alias("repeated"), F.count_if(_bit("u", 2) | F.col("menu")).alias("shown"),
        F.min("text_hash").alias("low"), F.max("text_hash").alias("high"),
    )
    t = t.where(F.col("records") >= LEAST_RECORDS)
    filler = F.col("repeated") >= REPEATED_SHARE * F.col("records")
    notice = (F.col("alone") >= ALONE_SHARE * F.col("records")) & (F.col("shown") > 0) & (F.col("low") < F.col("high"))
    return t.select("template", "records", "alone", "repeated", F.when(filler, "filler").when(notice, "notice").alias("kind")).where("kind is not null")


def kinds(documents: DataFrame) -> DataFrame:
    """doc_id, kind of the records to leave out, each once.

    documents: doc_id, text; further columns are ignored. Null, empty and blank
    texts are no case. If rows of one id differ, each kind comes out.
    """
    records = read_records(documents)
    verdicts = maybe_broadcast(materialize(mined_templates(records).select("template", "kind"), "p8-templates"), BROADCAST_ROWS)
    notices = F.col("error") + F.col("script")
    own = F.when(F.col("slot"), "placeholder").when(F.col("filler"), "filler").when((F.size("units") == 0) & (notices > 0), F.when(F.col("script") >= F.col("error"), "script_notice").otherwise("error_page"))
    alone = records.select("doc_id", own.alias("kind")).where("kind is not null")
    # the others have the verdicts of their templates; a record's units are distinct, so counts tell whether all have one
    open_ = records.where("not slot and not filler").where(F.size("units") > 0)
    u = open_.select("doc_id", "text_hash", "error", "script", F.size("units").alias("n"), F.explode("units").alias("u"))
    hit = u.withColumn("template", F.col("u").bitwiseAND(F.lit(-8).cast("long"))).join(verdicts, "template")
    g = hit.groupBy("doc_id", "text_hash", "error", "script", "n").agg(F.count_distinct(F.when(F.col("kind") == "notice", F.col("template"))).alias("notices"), F.count_if(F.col("kind") == "filler").alias("filler"), F.count_if(_bit("u", 2)).alias("speaks"))
    scripts = F.col("script") + F.col("speaks")
    mined = F.when(F.col("filler") > 0, "filler").when(F.col("notices") == F.col("n"), F.when((scripts > 0) & (scripts >= F.col("error")), "script_notice").otherwise("error_page"))
    return alone.union(g.select("doc_id", mined.alias("kind")).where("kind is not null")).distinct()


def without_residue(documents: DataFrame) -> DataFrame:
    """The documents without those records, all columns kept."""
    return documents.join(kinds(documents).select("doc_id").distinct(), "doc_id", "left_anti")
