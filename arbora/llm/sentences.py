"""Sentence boundaries across languages and scripts.

A text is cut at blank lines and around list lines; what lies between is scanned once for marks, quotes, brackets, emoji
and gaps of spaceless scripts. One pass pairs quotes and brackets, and nothing inside a pair splits.

* **Spaced scripts** are treated by a *terminator lattice*: every mark is a node with the readings end, abbreviation,
  title, number, initial, name, pause and joined word, each at a cost that the words on either side, the case of the
  passage and the sentence begun so far decide; the cheapest path through all marks of the block gives the ends.
* **Spaceless scripts** are segmented by a *dictionary word lattice* (cheapest path over known words and unknown letters).
  Thai words, and the words that open a run, are counted over the whole corpus (``learn``); Chinese and Japanese words come
  from a public vocabulary file. A gap between Thai words ends a sentence unless a number or repetition mark stands beside
  it; where no gap is written, a final particle followed by an opening word is one. After a Chinese or Japanese quote the
  words of the clause decide whether the sentence goes on (a quoting particle, a verb of saying).

Given the lexicon, the result is a function of the text alone: language columns are often wrong and are not read. Time is
linear in the length of a text.
"""

from __future__ import annotations

import base64
import os
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.runtime import cut

#: Public vocabulary whose Chinese and Japanese words are the dictionary; without the file single letters are.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Letters of the longest word counted, occurrences a word needs, and words that are kept, the most frequent first.
LONGEST, SEEN, WORDS = 8, 5, 50_000
#: A word opens sentences if it begins at least this share of its runs.
OPENS = 0.2
#: Share of a word's occurrences that must begin a line or follow a mark for it to open sentences.
STARTS = 0.1
#: Letters of the longest listed abbreviation: a longer word is none.
WORD_LETTERS = 24

# Abbreviations behind which a sentence never ends.
BEFORE_NAME = set("mr mrs ms dr dra prof st ft mt sr sra srta ud uds av avda hr fr fa sté mme mlle ste rev gen col sgt capt lic ing don doña gov sen rep hon pres".split())
BEFORE_WORD = set("approx aprox ca env incl inkl max min acc vs cf vgl bzw lt al i.e e.g c.-à-d p.ex p.ej d.h z.b u.a usf ebd evtl ggf resp art.cit".split())
# Abbreviations that stand before a number, and only then are one.
BEFORE_NUMBER = set("no nr núm num nos fig figs abb tab pág pag págs pp p s bd vol ch chap cap kap art sec eq ex ej tel str n".split())
# Abbreviations that may end a sentence.
MAY_END = set("etc usw a.m p.m u.s u.k inc ltd corp co bros jr sr.ltd llc".split())
COMPANY = set("inc ltd corp co bros llc".split())
# What German ordinals stand behind.
ORDINAL = set("am im der die das den dem des vom zum zur beim ab bis seit".split())
# File name endings.
FILE_ENDINGS = set("exe txt pdf com org net html htm php py js zip jpg png csv json xml doc docx md io de fr es".split())
# Words that open a sentence, for passages whose case says nothing.
OPENERS = set(
    "the it i we my our you he she they this that these those there is are what how why who whoever which has have could do does did no not very after"
    " el la los las lo una por mi se le les je il elle c'est pour mon ma ich wir ein eine für auch leider when as if".split()
)
# Verbs of saying and quoting particles that follow a quote.
CJK_QUOTING = ("と", "って", "という", "の", "は", "が", "を", "に", "で", "も", "だ", "です")
CJK_SAYING = ("说", "說", "道", "喊", "问", "問", "叫", "答", "言", "嚷", "骂", "写", "寫", "想", "叹", "嘆")
# Thai final particles; behind the polite ones a sentence can end without a gap.
THAI_FINAL = set("ค่ะ คะ ครับ ครับผม นะคะ นะครับ นะ จ้ะ จ้า เลย แล้ว".split())
THAI_POLITE = set("ค่ะ คะ ครับ ครับผม นะคะ นะครับ จ้ะ จ้า".split())

MARKS = ".!?…。！？．؟।॥۔‼⁇⁈⁉"
STRONG_CJK = "。！？．"
OPEN = "«„“「『《〈【（([{‹"
CLOSE = {"»": "«", "”": "“„", "“": "„", "」": "「", "』": "『", "》": "《", "〉": "〈", "】": "【", "）": "（", ")": "(", "]": "[", "}": "{", "›": "‹"}
ROUND = "（([{【"
EMOTICON = r"(?:[:;=]-?[)(DPp/|*]|\([ynYN]\)|<3|\^[_.]?\^|[xX]D\b|¯\\_\(ツ\)_/¯)"
EMOJI = r"(?:\p{RI}\p{RI}|[\p{Extended_Pictographic}--[0-9#*©®™]][‍️\p{Emoji_Modifier}\p{Extended_Pictographic}]*)"
TRAIL = regex.compile(rf"(?V1)(?:[ \t 　]*(?:{EMOJI}|(?<![\w:]){EMOTICON}))+")
TOKEN = regex.compile(
    rf"""(?V1)(?P<face>(?<!\w){EMOTICON})|(?P<mark>[{MARKS}]+(?:[ ](?=[!?]))?[!?]*)|(?P<straight>")|(?P<open>[«„“「『《〈【（(\[{{‹])|(?P<close>[»”」』》〉】）)\]}}›])|(?P<gap>(?<=[฀-๿])[\s ]+|​(?=[฀-๿]))|(?P<thai>[฀-๿]{{4,}})"""
)
#: White space of any kind, no-break space and byte-order mark included.
SPACE = "".join(chr(c) for c in (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF))
_TRIM = regex.compile(rf"[{SPACE}]+")
_BLANK = regex.compile(rf"[^\S\n]*[﻿]*")
_BULLET = regex.compile(r"[^\S\n\r]*(?:[-*•‣◦▪–—·+]\s+\S|・|[①-⑳]|[(（]?\d{1,3}[、．）]\s*\S|(\d{1,3})[.)]\s+\S)")
_WORDISH = regex.compile(r"[\p{L}\p{M}\p{N}.'’\-]+")
_AFTER_CJK = regex.compile(r"[^\p{Han}\p{Hiragana}\p{Katakana}ー]+$|[\p{Han}\p{Hiragana}\p{Katakana}ー]?$")
_WORD = regex.compile(r"[\p{L}\p{M}\p{N}'’]+")
_NEXT = regex.compile(rf"([{SPACE}]*)(.?)", regex.S)
_NUMBER, _DAY, _DOTTED = regex.compile(r"[\d.,]+"), regex.compile(r"\d{1,2}(?:\.\d{1,2})?"), regex.compile(r"(?:\p{L}\.)+\p{L}")
_DIGIT_END, _CAPITAL_END = regex.compile(r"\d\s?$"), regex.compile(r"[.\p{Lu}]\s*$")
_DEVANAGARI, _WORDY, _BREAK = regex.compile(r"\p{Devanagari}"), regex.compile(r"[\p{L}\p{N}]"), regex.compile("\r\n|[\n\r\u2028\u2029\x85]")
_LETTER = regex.compile(r"\p{L}")
_CJK = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}ー々]")
_CLAUSE = regex.compile(r"[^。！？!?\n「『“«„（(]*")
_PICTURE = regex.compile(rf"(?V1){EMOJI}|[\u200d\ufe0f\p{{Emoji_Modifier}}]")
_BEHIND = SPACE + "\"'»”“’)]）」』"
_CASELESS = regex.compile(r"[\p{Arabic}\p{Hebrew}\p{Devanagari}\p{Thai}\p{Han}\p{Hiragana}\p{Katakana}]")


def word_path(text: str, words: set[str], longest: int = 14) -> list[str]:
    """Cheapest path through the word lattice of ``text``: a known word costs 1, an unknown letter 1.5."""
    best: list[tuple[float, int, str]] = [(0.0, 0, "")]
    for end in range(1, len(text) + 1):
        options = [(best[end - 1][0] + 1.5, end - 1, text[end - 1])]
        options += [(best[i][0] + 1.0, i, text[i:end]) for i in range(max(0, end - longest), end) if text[i:end] in words]
        best.append(min(options))
    path, end = [], len(text)
    while end:
        path.append(best[end][2])
        end = best[end][1]
    return path[::-1]


@dataclass(frozen=True)
class Lexicon:
    """What the lattices know: Thai words, Thai words that open a run, words written with an exclamation mark, and words of
    spaced scripts that open sentences."""

    thai: frozenset = field(default_factory=frozenset)
    openers: frozenset = field(default_factory=frozenset)
    exclaimed: frozenset = field(default_factory=frozenset)
    starters: frozenset = field(default_factory=frozenset)

    def opens(self, word: str) -> bool:
        """Whether a word of a spaced script tells that a sentence begins."""
        return word.lower() in OPENERS or word.lower() in self.starters

    def thai_joints(self, run: str) -> list[int]:
        """Offsets in a Thai run without gaps where a polite final particle is followed by an opening word."""
        if not any(p in run for p in THAI_POLITE):
            return []
        path, at, out = word_path(run, self.thai | THAI_FINAL), 0, []
        for w, following in zip(path, [*path[1:], ""]):
            at += len(w)
            if w in THAI_POLITE and following not in THAI_FINAL and any(following.startswith(o) or run.startswith(o, at) for o in (following[:n] for n in range(2, len(following) + 1)) if o in self.openers):
                out.append(at)
        return out


@lru_cache(maxsize=2)
def cjk_words(path: str) -> frozenset:
    """Words of two and more Chinese or Japanese letters in a vocabulary file; none without the file."""
    if not os.path.exists(path):
        return frozenset()
    found = set()
    with open(path, "rb") as f:
        for line in f:
            try:
                word = base64.b64decode(line.split()[0]).decode().strip()
            except (ValueError, IndexError):
                continue
            if len(word) > 1 and regex.fullmatch(r"[\p{Han}\p{Hiragana}\p{Katakana}ー]+", word):
                found.add(word)
    return frozenset(found)


#: A reading that cannot hold.
NEVER = 9.0


class Block:
    """The sentences of one block: no blank line and no list line within."""

    def __init__(self, text: str, lexicon: Lexicon):
        self.text, self.lexicon = text, lexicon
        upper = sum(map(str.isupper, text))
        self.cased = 0 < upper < 0.7 * (upper + sum(map(str.islower, text)))
        # Word before each position, found as the marks come in order.
        self.words = [m.span() for m in _WORDISH.finditer(text)]
        self.reached = 0

    def first(self, at: int) -> int:
        m = _TRIM.match(self.text, at)
        return m.end() if m else at

    def sentences(self) -> list[tuple[int, int]]:
        text = self.text
        tokens = [(m.lastgroup, m.start(), m.end()) for m in TOKEN.finditer(text)]
        partner = self.paired(tokens)
        # Hypotheses (cost, begin of the open sentence, ends so far as a chain): the last node an end, or not.
        best = [(0.0, self.first(0), None)]
        last_mark, skip, depth = -1, 0, 0
        for n, (kind, at, end) in enumerate(tokens):
            if at < skip or kind == "face":
                continue
            if kind == "thai":
                if not depth:
                    for joint in self.lexicon.thai_joints(text[at:end]):
                        best = self.step(best, self.trail(at + joint), lambda start: (0.0, NEVER))
                continue
            if kind == "gap":
                if not depth and self.gap(at, end):
                    best = self.step(best, self.trail(at), lambda start: (0.0, NEVER))
                continue
            if kind in ("straight", "open", "close"):
                if n not in partner:
                    continue
                if partner[n] > n:
                    depth += 1
                    continue
                depth -= 1
                opened = tokens[partner[n]][1]
                if last_mark >= opened and not text[last_mark:at].strip(SPACE):
                    last_mark = end
                    if not depth:
                        skip = self.trail(end)
                        best = self.step(best, skip, lambda start: self.closed(text[at], opened, end, skip, start))
                continue
            last_mark = end
            if not depth:
                skip = self.trail(end)
                best = self.step(best, skip, lambda start: self.mark(text[at:end], at, end, skip, start))
        chain, ends = min(best, key=lambda h: h[0])[2], [len(text)]
        while chain:
            ends.append(chain[0])
            chain = chain[1]
        out, s = [], self.first(0)
        for e in reversed(ends):
            stop = s + len(text[s:e].rstrip(SPACE))
            if stop > s:
                out.append((s, stop))
            s = max(s, self.first(e))
        return out

    def step(self, best: list, stop: int, readings) -> list:
        """The hypotheses behind one more node: ``readings`` gives the costs of an end at ``stop`` and of none."""
        ended, within, sure = None, None, False
        for cost, start, chain in best:
            end, none = readings(start)
            if ended is None or cost + end < ended[0]:
                ended = (cost + end, self.first(stop), (stop, chain))
                sure = end < NEVER <= none
            if within is None or cost + none < within[0]:
                within = (cost + none, start, chain)
        if sure:
            return [ended]
        return [within] if ended[0] >= within[0] + NEVER else [ended, within]

    def paired(self, tokens: list) -> dict[int, int]:
        """Tokens of quotes and brackets by their partner, in one pass; what has none is left out.

        A closer takes the nearest opener of its kind, and openers in between stay without partner.
        """
        text, stack, open_now, out = self.text, [], dict.fromkeys([*OPEN, '"'], 0), {}
        for n, (kind, at, end) in enumerate(tokens):
            if kind not in ("straight", "open", "close"):
                continue
            char = text[at]
            if kind == "straight":
                # A mark of inches opens nothing.
                closing, fits = open_now['"'] > 0, '"'
                if not closing and (at > 0 and text[at - 1].isalnum() or not text[end : end + 1].strip(SPACE)):
                    continue
            elif char == "“":
                closing, fits = bool(stack) and stack[-1][0] == "„", "„"
            else:
                closing, fits = kind == "close", CLOSE.get(char, "")
            if not closing:
                stack.append((char, n))
                open_now[char] += 1
            elif any(open_now[c] for c in fits):
                while stack:
                    was, k = stack.pop()
                    open_now[was] -= 1
                    if was in fits:
                        out[k], out[n] = n, k
                        break
        return out

    def trail(self, at: int) -> int:
        m = TRAIL.match(self.text, at)
        return m.end() if m else at

    def gap(self, at: int, end: int) -> bool:
        """Whether a written gap behind Thai letters ends a sentence."""
        before, after = self.text[at - 1], self.text[end : end + 1]
        return bool(after) and before not in "ๆ" and not before.isdigit() and not after.isdigit() and after not in MARKS and after not in ")]»”,;:"

    def closed(self, char: str, opened: int, end: int, stop: int, start: int) -> tuple[float, float]:
        """Costs behind a quote or bracket from ``opened`` that ended with a mark."""
        text, whole = self.text, opened <= start
        ends, goes_on = (0.2, 1.0), (1.0, 0.2)
        face = stop > end
        m = _NEXT.match(text, end)
        gap, after, at = m.group(1), m.group(2), m.start(2)
        if not after or face:
            return ends
        if after in ",;:，、；：。.!?！？)]":
            return goes_on
        if char in ")）]】}":
            return ends if whole else goes_on
        if _CJK.match(after):
            if char in "」』":
                return ends if whole and not any(text.startswith(q, at) for q in CJK_QUOTING) else goes_on
            if not whole:
                return ends if text[max(0, opened - 20) : opened].rstrip()[-1:] in ("：", ":") else goes_on
            said = any(all(c in CJK_SAYING for c in w) for w in self.clause(at))
            return goes_on if said else ends
        if _CASELESS.match(after):
            return ends if not gap and after not in MARKS and whole else goes_on
        opener = self.lexicon.opens(self.word(at))
        if after.islower() or not self.cased and after.isalpha():
            return ends if not whole and opener else goes_on
        return ends if gap or not after.isdigit() else goes_on

    def clause(self, at: int) -> list[str]:
        """Words of a Chinese or Japanese clause, up to the next mark or quote."""
        m = _CLAUSE.match(self.text, at)
        return word_path(m.group(), cjk_words(VOCABULARY))

    def word(self, at: int) -> str:
        m = _WORD.match(self.text, at)
        return m.group() if m else ""

    def before(self, at: int) -> tuple[str, str]:
        """The word that ends at ``at`` ('' if none does, its last letters if it is longer than any listed) and the one before
        it in lower case."""
        while self.reached < len(self.words) and self.words[self.reached][0] < at:
            self.reached += 1
        k = self.reached - 1
        # A run of word letters may go on behind the mark, which can be a dot within it.
        if k < 0 or self.words[k][1] < at:
            return "", ""
        lo = max(self.words[k][0], at - WORD_LETTERS)
        found = self.text[lo:at]
        tail = _AFTER_CJK.search(found).group()
        previous = ""
        if k and lo == self.words[k][0] and tail == found and not self.text[self.words[k - 1][1] : lo].strip(SPACE):
            a, b = self.words[k - 1]
            previous = self.text[max(a, b - WORD_LETTERS) : b].lower()
        return tail, previous

    def mark(self, mark: str, at: int, end: int, stop: int, start: int) -> tuple[float, float]:
        """Costs of an end and of none at a run of marks outside all quotes and brackets."""
        text = self.text
        m = _NEXT.match(text, end)
        gap, after, next_at = m.group(1), m.group(2), m.start(2)
        if not after:
            return 0.0, NEVER
        face = stop > end
        if not face and (after in ",;:，、；：" or after in "-–" and not gap):
            return NEVER, 0.0
        if any(c in "।॥؟۔" or c in STRONG_CJK for c in mark):
            return 0.0, NEVER
        if mark.strip(".…") == "" and (len(mark) > 1 or "…" in mark):
            return self.pause(gap, after, next_at, face)
        before, previous = self.before(at)
        word = self.word(next_at)
        if mark[0] != "." or len(mark) > 1:
            return self.exclamation(mark, before, gap, after, word, at - len(before) > start)
        readings = self.readings(before, previous, gap, after, word, at, face)
        return readings.pop("end"), min(readings.values(), default=NEVER)

    def exclamation(self, mark: str, before: str, gap: str, after: str, word: str, inside: bool) -> tuple[float, float]:
        """A mark that ends a sentence unless it belongs to a name or number."""
        if not gap and after.isdigit():
            return 1.0, 0.2
        name = NEVER
        if mark == "!" and word.lower() not in OPENERS:
            if self.cased and gap and after.islower() and before[:1].isupper() and not before.isupper() and inside:
                name = 0.4
            elif not self.cased and before.lower() in self.lexicon.exclaimed:
                name = 0.4
        return 0.8, name

    def pause(self, gap: str, after: str, at: int, face: bool) -> tuple[float, float]:
        """Dots that end a sentence or mark a pause in it."""
        opener = self.word(at).lower() in OPENERS - {"how", "the"}
        if face:
            return 0.0, 1.0
        if _CASELESS.match(after):
            return (0.2, 1.0) if gap and not _CJK.match(after) else (1.0, 0.2)
        starts = after.isupper() and self.cased or after in "¿¡«„“\"(" or opener and gap and after.isupper()
        return (0.2, 1.0) if starts else (1.0, 0.2)

    def readings(self, before: str, previous: str, gap: str, after: str, word: str, at: int, face: bool) -> dict[str, float]:
        """Costs of the readings of a period."""
        text, low = self.text, before.lower().strip("'’-")
        opener, upper = self.lexicon.opens(word), after.isupper() and self.cased
        starts = upper or after in "¿¡«„“\"'(" or bool(_CASELESS.match(after))
        out = {"end": 1.0}
        if not gap:
            if after.isdigit() or after in "-_/@°º%":
                plain = after.isdigit() and low.isalpha() and len(low) > 3 and low not in BEFORE_NUMBER
                return out | {"number": 2.0 if plain else 0.2}
            if face:
                return {"end": 0.0}
            if after.isalpha() and not _CASELESS.match(after) and (after.islower() or not self.cased):
                alone = low.isalpha() and len(low) > 2 and low not in BEFORE_WORD | BEFORE_NAME | BEFORE_NUMBER
                numbered = bool(_NUMBER.fullmatch(low)) and len(word) > 2
                dotted = low in MAY_END and "." in low and opener
                two = (alone or numbered or dotted) and word.lower() not in FILE_ENDINGS and len(word) > 1
                if not two:
                    out["joined"] = 0.5
                elif not (low in MAY_END or low in COMPANY):
                    return out
        if not before:
            return out
        if _CASELESS.match(before[-1]):
            letters = len(_LETTER.findall(before))
            return out | ({"abbreviation": 0.5} if letters == 1 or _DEVANAGARI.match(before[-1]) and letters <= 3 else {})
        if low in BEFORE_NAME:
            out["title"] = 0.2
        elif low in BEFORE_WORD:
            out["abbreviation"] = 1.5 if face else 0.2
        elif low in BEFORE_NUMBER and len(low) > 1:
            out["number"] = 0.2 if after.isdigit() or low in ("ex", "ej") and previous.strip(".") == "p" else 2.0
        elif low in MAY_END:
            out["abbreviation"] = 0.8
            free = not self.cased and (low in ("etc", "usw") or low in ("p.m", "u.s", "u.k") and word.lower() not in ("on", "in", "at", "and", "or", "by", "to", "so", "but"))
            fresh = after in "¿¡«„“\"(" or bool(_CASELESS.match(after))
            if face or fresh or opener or low not in COMPANY and (after.isdigit() or upper or free):
                out["end"] = 0.5
        elif len(low) == 1 and low.isalpha():
            out["initial"] = 0.5
            unit = bool(_DIGIT_END.search(text[max(0, at - 3) : at - 1])) and not after.isdigit() and (opener or upper or not after.isalpha())
            if unit:
                out["end"] = 0.2  # a unit behind its number
            elif after.isdigit() or after.islower() or not self.cased or len(word) == 1:
                out["end"] = 0.2 if face else 1.0
            elif before.isupper() and opener and previous and previous not in BEFORE_NAME and not _CAPITAL_END.search(text[max(0, at - 4) : at - 1]):
                out["end"] = 0.2
            elif not after.isalpha() and after in "¿¡«„":
                out["end"] = 0.2
        elif len(low) == 2 and low.isalpha() and low[0] == low[1] and (before.isupper() or not self.cased):
            out["initial"] = 0.5
            if opener and upper:
                out["end"] = 0.2
        elif _DOTTED.fullmatch(low):
            out["initial"] = 0.5
            if starts and opener:
                out["end"] = 0.2
        elif _DAY.fullmatch(low) and previous in ORDINAL:
            out["ordinal"] = 0.2
        return out


def _lines(text: str) -> list[tuple[int, int]]:
    out, s = [], 0
    for m in _BREAK.finditer(text):
        out.append((s, m.start()))
        s = m.end()
    return [*out, (s, len(text))]


def _ends_sentence(line: str) -> bool:
    end = len(line)
    while end and (line[end - 1] in _BEHIND or _PICTURE.match(line, end - 1)):
        end -= 1
    return end > 0 and line[end - 1] in MARKS + ":："


def _thai_end(line: str) -> bool:
    end = len(line)
    while end and not (line[end - 1].isalnum() or line[end - 1] == "_" or "\u0e00" <= line[end - 1] <= "\u0e7f"):
        end -= 1
    return end > 0 and "\u0e00" <= line[end - 1] <= "\u0e7f"


def sentences(text: str | None, lexicon: Lexicon = Lexicon()) -> list[tuple[int, int]]:
    """(start, end) of each sentence in code points. None for null, empty and blank texts."""
    if not text or not text.strip(SPACE):
        return []
    if not _WORDY.search(text):
        lo = _TRIM.match(text)
        hi = len(text.rstrip(SPACE))
        return [(lo.end() if lo else 0, hi)]
    out: list[tuple[int, int]] = []
    block: tuple[int, int] | None = None
    last = ""  # the last line of the block
    listed, blank = False, True

    def flush():
        nonlocal block
        if block:
            lo, hi = block
            out.extend((lo + s, lo + e) for s, e in Block(text[lo:hi], lexicon).sentences())
            block = None

    for lo, hi in _lines(text):
        line = text[lo:hi]
        if not line.strip(SPACE):
            flush()
            listed, blank = False, True
            continue
        bullet = _BULLET.match(line)
        if bullet and bullet.group(1) and not (blank or listed or block and _ends_sentence(last)):
            bullet = None
        if bullet:
            flush()
            s, e = lo, hi
            m = _TRIM.match(text, s, e)
            s = m.end() if m else s
            e = s + len(text[s:e].rstrip(SPACE))
            out.append((s, e))
            listed, blank = True, False
            continue
        if listed:
            flush()
        if block and _ends_sentence(last) and _thai_end(last):
            flush()
        block, last = (block[0] if block else lo, hi), line
        listed, blank = False, False
    flush()
    return out


def learn(df: DataFrame, text: str = "text") -> Lexicon:
    """The lexicon of a corpus, counted over all its texts.

    A Thai word is a string of up to ``LONGEST`` letters that stands at least ``SEEN`` times and is bounded on both sides: by
    the end of a run or by at least three different neighbours. It holds no polite particle and begins with no mark that
    leans on the letter before. Opening words begin a share of ``OPENS`` of their runs. A word is written with an
    exclamation mark if it is followed by a small letter at least three times and in half of its occurrences so marked.
    Words of spaced scripts open sentences if a share of ``STARTS`` stands behind a line break or a mark of another kind
    than the period.
    The lexicon has at most ``WORDS`` words, which bounds what is shipped.
    """
    texts = df.select(F.col(text).alias("t")).where("t is not null")
    found = texts.select(F.explode(F.regexp_extract_all("t", F.lit(r"(?:[0-9%] ?)?[\u0E00-\u0E7F]{2,}"), 0)).alias("r"))
    # What follows a number goes on with its sentence.
    runs = cut(found.groupBy(F.regexp_replace("r", "^[0-9%] ?", "").alias("run"), (~F.col("r").rlike("^[0-9%]")).alias("free")).agg(F.count("*").alias("n")))
    size = F.length("run")
    cuts = runs.select("run", "free", "n", F.explode(F.sequence(F.lit(1), size)).alias("i")).select("run", "free", "n", "i", F.explode(F.sequence(F.lit(1), F.least(F.lit(LONGEST + 1), size - F.col("i") + 1))).alias("l"))
    parts = cuts.select(F.expr("substring(run, i, l)").alias("w"), "n", (F.col("i") == 1).alias("head"), "free", (F.col("i") + F.col("l") == size + 1).alias("tail"))
    counts = cut(parts.groupBy("w").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("head"), F.col("n")).otherwise(0)).alias("heads"), F.sum(F.when(F.col("head") & F.col("free"), F.col("n")).otherwise(0)).alias("opened"), F.sum(F.when(F.col("tail"), F.col("n")).otherwise(0)).alias("tails")))
    right = counts.where("length(w) > 1").groupBy(F.expr("left(w, length(w) - 1)").alias("r")).agg(F.count("*").alias("rights"))
    left = counts.where("length(w) > 1").groupBy(F.expr("right(w, length(w) - 1)").alias("l")).agg(F.count("*").alias("lefts"))
    inner = "|".join(sorted(THAI_POLITE))
    known = counts.where(f"length(w) between 2 and {LONGEST} and n >= {SEEN}").where(~F.col("w").rlike(r"^[\u0E30-\u0E3A\u0E45\u0E47-\u0E4E]") & ~F.col("w").rlike(inner))
    known = known.join(right, F.col("w") == F.col("r"), "left").join(left, F.col("w") == F.col("l"), "left")
    known = known.where("(heads > 0 or lefts >= 3) and (tails > 0 or rights >= 3)").orderBy(F.desc("n"), "w").limit(WORDS)
    rows = known.select("w", (F.col("opened") >= F.col("n") * OPENS).alias("opens")).collect()
    marked = texts.select(F.explode(F.regexp_extract_all("t", F.lit(r"(\p{L}+!(?: \p{Ll})?)"), 1)).alias("m"))
    shouted = marked.groupBy(F.lower(F.substring_index("m", "!", 1)).alias("w")).agg(F.count("*").alias("n"), F.count_if(F.col("m").rlike("! ")).alias("on"))
    names = shouted.where("on >= 3 and on * 2 >= n").orderBy(F.desc("n"), "w").limit(WORDS).collect()
    words = texts.select(F.explode(F.regexp_extract_all("t", F.lit(r"(?:(?:^|[!?\n])\s*)?[\p{L}][\p{L}\p{M}'’]*"), 0)).alias("m"))
    opened = words.groupBy(F.lower(F.regexp_replace("m", r"^[!?\s]+", "")).alias("w")).agg(F.count("*").alias("n"), F.count_if(F.col("m").rlike(r"^[!?\n]")).alias("first"))
    starters = opened.where(F.col("first") >= F.greatest(F.lit(SEEN), F.col("n") * STARTS)).orderBy(F.desc("n"), "w").limit(WORDS).collect()
    return Lexicon(frozenset(r.w for r in rows), frozenset(r.w for r in rows if r.opens), frozenset(r.w for r in names), frozenset(r.w for r in starters))


def split_table(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, start_pos int, end_pos int): every sentence of every text, whole texts of any length, by the corpus's lexicon.

    Null and blank texts have none. Repeated rows are split each; other columns are not read.
    """
    kind, lexicon = dict(df.dtypes)[key], learn(df, text)

    def run(batches):
        for b in batches:
            at, starts, ends = [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                for s, e in sentences(t, lexicon):
                    at.append(i)
                    starts.append(s)
                    ends.append(e)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=["key", "start_pos", "end_pos"])

    return df.select(key, text).mapInArrow(run, f"key {kind}, start_pos int, end_pos int").withColumnRenamed("key", key)
