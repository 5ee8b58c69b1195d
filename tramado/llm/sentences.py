"""Sentence boundaries across languages and scripts: a linear-chain model over characters, decoded by Viterbi.

Every character is tagged: a sentence ends before it, or it is inside one. Away from marks that can end a sentence,
line breaks, and (in scripts written without full stops) blanks, the tag "end" is ruled out, so the chain is decoded
over the remaining places only, which changes nothing in the result. A place's score is a sum of weights of its
features: the marks, their neighbours, quotation, layout, and the words and letters around; neighbouring places are
tied by weights of their tags and distance. All texts of a batch are read as one array of code points.

The weights are fitted here, on a bounded sample of documents, to labels that marks and layout show (``certain``). The
labels decide nothing afterwards: neither a prior nor a rule enters the decoding, and while fitting, each view of a place
is hidden at random, so that no single one carries the result. For scripts without full stops the sample is stripped of
punctuation first and keeps the labels of the text as written, so that ends are learned from letters and layout alone.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .wordarrays import chunks, hash_words

SAMPLE = 2000
TABLE = 1 << 18
WRAP = 110
NARROW = 70
SLACK = 10
TIE = 0.2
VIEWS = 10
DOT_BITS = 16
_END = "\x1e"
OTHER, LOWER, UPPER, DIGIT, UNCASED, OPEN, SPACE, LINE, STOP, CLOSE, COMMA, DASH, SEP = range(13)
# Marks by what they do.
STOPS = ".!?。！？।॥؟…｡؛۔።"
CLOSERS = ")]»”’」』）】›"
OPENERS = "«“‘¿¡„「『（(["
COMMAS = ",;:、，；：،"
BULLETS = "-*•–·‣▪◦"
# Abbreviations after which a name or number follows, so that no sentence ends there.
BEFORE_NAMES = (
    "sr sra srta srs sres dr dra drs dres ing lic prof profa arq abg cdte cnel gral cap tte sgto mr mrs ms st sta sto fr "
    "hon gov sen rep gen col lt capt mons pbro av avda depto dept dto ee d u z vgl bzw nr hr fr frl mme mlle mgr me "
    "डॉ श्री श्रीमती सं रु प्रो कु أ وأ د ود م وم"
).split()
BEFORE_NUMBERS = "art arts fig figs pag pags pp p n no nos num nro nº cap vol aprox approx ca env cf abs sec sect par parr inc ed etapa tel ext min max".split()
MONTHS = "januar februar marz april mai juni juli august september oktober november dezember janner".split()


@lru_cache(1)
def _classes() -> np.ndarray:
    t = np.zeros(0x10000, np.int8)
    for i in range(0x10000):
        c = chr(i)
        k = unicodedata.category(c)
        if k in ("Lu", "Lt"):
            t[i] = UPPER
        elif k == "Ll":
            t[i] = LOWER
        elif k in ("Lo", "Lm", "Mn", "Mc"):
            t[i] = UNCASED
        elif k == "Nd":
            t[i] = DIGIT
        elif k == "Zs" or c == "\t":
            t[i] = SPACE
    for marks, k in ((STOPS, STOP), (CLOSERS, CLOSE), (OPENERS, OPEN), (COMMAS, COMMA), ("—–―", DASH), ("\n\r  \x0b\x0c", LINE), (_END, SEP), ("　​﻿\xad", SPACE)):
        for c in marks:
            t[ord(c)] = k
    return t


def _is(c: np.ndarray, marks: str) -> np.ndarray:
    return np.isin(c, np.array([ord(m) for m in marks], np.uint32))


def _unpunctuated(c: np.ndarray) -> np.ndarray:
    """Thai, Lao, Burmese, Khmer: written without full stops."""
    return ((c >= 0x0E00) & (c <= 0x0EFF)) | ((c >= 0x1000) & (c <= 0x109F)) | ((c >= 0x1780) & (c <= 0x17FF))


def _hashes(words: list[str]) -> np.ndarray:
    out = []
    for w in words:
        x = np.array([ord(ch) for ch in unicodedata.normalize("NFC", w)], np.uint32)
        out.append(hash_words(x, np.array([0]), np.array([len(x)]))[0])
    return np.array(sorted(set(out)), np.uint64)


@lru_cache(1)
def _lists() -> tuple[np.ndarray, np.ndarray]:
    return _hashes(BEFORE_NAMES), _hashes(BEFORE_NUMBERS)


@lru_cache(1)
def _months() -> np.ndarray:
    return _hashes(MONTHS)


class Places:
    """The places of a batch where a sentence may end, and their features."""

    def __init__(self, texts: list[str]):
        joined = _END + _END.join(t.replace(_END, " ") if _END in t else t for t in texts) + _END
        c = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        low = np.minimum(c, 0xFFFF)
        k = np.where(c < 0x10000, _classes()[low], OTHER).astype(np.int8)
        pad = 4
        self.c = c = np.concatenate((c, np.full(pad, ord(_END), np.uint32)))
        self.k = k = np.concatenate((k, np.full(pad, SEP, np.int8)))
        self.bounds = np.flatnonzero(k[:-pad] == SEP)  # text i lies between bounds[i] and bounds[i + 1]
        solid = np.flatnonzero((k != SPACE) & (k != LINE))
        self.solid = solid
        n = len(c)

        # After a run of stops and the closing marks that belong to it.
        stop = k == STOP
        run_end = np.flatnonzero(stop[:-1] & ~stop[1:]) + 1
        run_start = np.flatnonzero(np.concatenate((stop[:1], stop[1:] & ~stop[:-1])))
        b = run_end.copy()
        quote = np.zeros(len(b), bool)
        round_ = np.zeros(len(b), bool)
        letter = np.isin(k, (LOWER, UPPER, DIGIT, UNCASED)) | (k == OPEN)
        for _ in range(3):
            at = np.minimum(b, n - 3)
            x = c[at]
            mark = (k[at] == CLOSE) | (((x == 0x201C) | (x == 0x22) | (x == 0x27)) & ~letter[at + 1])
            spaced = (k[at] == SPACE) & (c[at + 1] == 0xBB)
            quote |= (mark & ~_is(x, ")]）】")) | spaced
            round_ |= mark & _is(x, ")]）】")
            b = np.where(mark, b + 1, np.where(spaced, b + 2, b))
        # Line breaks, ends of texts, and blanks in scripts without full stops.
        white = (k == SPACE) | (k == LINE)
        ws = np.flatnonzero(white & ~np.concatenate(([False], white[:-1])))
        we = np.flatnonzero(white[:-1] & ~white[1:]) + 1  # the array ends with separators
        lines = np.cumsum(np.concatenate(([0], (k == LINE) & ~((c == 10) & np.concatenate(([False], c[:-1] == 13))))))
        broken = (lines[we] - lines[ws]) > 0
        prev, nxt = k[np.maximum(ws - 1, 0)], k[np.minimum(we, n - 1)]
        bare = _unpunctuated(c[np.maximum(ws - 1, 0)]) | _unpunctuated(c[np.minimum(we, n - 1)])
        gap = (broken | bare) & (prev != SEP) & (nxt != SEP)
        last = np.searchsorted(solid, self.bounds[1:]) - 1
        ends = solid[last] + 1
        ends = ends[solid[last] > self.bounds[:-1]]
        every = np.concatenate((b, ws[gap], ends))
        self.b = b_all = np.unique(every)
        pos = np.searchsorted(b_all, b)
        m = len(b_all)
        self.stop = np.zeros(m, bool)
        self.stop[pos] = True
        self.run = np.full(m, -1)
        self.run[pos] = run_start
        size = np.zeros(m, int)
        size[pos] = run_end - run_start
        first = np.zeros(m, np.uint32)
        first[pos] = c[run_end - 1]
        self.quote, self.round = np.zeros(m, bool), np.zeros(m, bool)
        np.logical_or.at(self.quote, pos, quote)
        np.logical_or.at(self.round, pos, round_)
        self.next = nx = solid[np.minimum(np.searchsorted(solid, b_all), len(solid) - 1)]
        self.nk = k[nx]
        self.doc = np.searchsorted(self.bounds, b_all - 1, "right") - 1
        self.final = self.nk == SEP
        breaks = lines[nx] - lines[b_all]
        self.gap = np.where(nx == b_all, 0, np.where(breaks == 0, 1, np.where(breaks == 1, 2, 3)))
        self.dot = self.stop & (first == 46) & (size == 1)
        self.ellipsis = self.stop & (((first == 46) & (size >= 2)) | (first == 0x2026))
        self.full = self.stop & ~self.ellipsis & ~np.isin(first, (46, 33, 63))

        # The word before the stop.
        head = np.where(self.stop, self.run, b_all)
        wordy = np.isin(k, (LOWER, UPPER, DIGIT, UNCASED))
        edge = np.flatnonzero(~wordy)
        start = edge[np.maximum(np.searchsorted(edge, head) - 1, 0)] + 1
        self.start, self.head = start, head
        length = head - start
        lc = _lower(c)
        h = hash_words(lc, np.minimum(start, head), head) if m else np.zeros(0, np.uint64)
        self.word = h
        names, numbers = _lists()
        short = (length > 0) & (length <= 10)
        self.name, self.number = short & np.isin(h, names), short & np.isin(h, numbers)
        before = c[np.maximum(start - 1, 0)]
        bk = k[np.maximum(start - 1, 0)]
        apart = np.isin(bk, (SPACE, LINE, SEP, OPEN, DASH, COMMA))
        kind1 = k[np.maximum(head - 1, 0)]
        self.initial = (length == 1) & apart & (kind1 == UPPER)
        self.letter = (length == 1) & apart & (kind1 == UNCASED) & (c[np.maximum(head - 1, 0)] < 0x2000)
        self.inner = (length > 0) & (before == 46)
        self.digits = (length > 0) & (length <= 4) & (kind1 == DIGIT)
        # Layout: the line a place ends, and the next one.
        brk = np.flatnonzero((k == LINE) | (k == SEP))
        line = brk[np.maximum(np.searchsorted(brk, b_all) - 1, 0)] + 1
        line_begin = solid[np.minimum(np.searchsorted(solid, line), len(solid) - 1)]
        at_start = start == line_begin
        roman = self.initial & at_start | ((length <= 4) & (length > 0) & at_start & _is(c[np.minimum(start, n - 1)], "IVX") & (kind1 == UPPER))
        self.mark = self.dot & at_start & (self.digits | roman) & (self.gap == 1)
        listed = self._listed()
        self.entry, self.next_entry = listed[line_begin], listed[nx]
        upto = brk[np.minimum(np.searchsorted(brk, b_all), len(brk) - 1)]
        every_line = np.diff(brk) - 1
        owner = np.searchsorted(self.bounds, brk[:-1], "right") - 1
        width = np.zeros(len(texts) + 1, int)
        if len(every_line):
            np.maximum.at(width, np.clip(owner, 0, len(texts)), every_line)
        w = width[np.clip(self.doc, 0, len(texts))]
        nc = c[nx]
        cjk = ((nc >= 0x2E80) & (nc <= 0x9FFF)) | ((nc >= 0xF900) & (nc <= 0xFFEF)) | _unpunctuated(nc)
        # A text is wrapped if lines break before a small letter; the shortest such line shows the width. Scripts without
        # small letters have no such sign: there, long lines of a narrow text are taken as wrapped.
        long_ = upto - line
        broken_word = ~self.stop & (self.gap == 2) & (self.nk == LOWER) & ~self.entry
        width = np.full(len(texts) + 1, 1 << 30)
        np.minimum.at(width, np.clip(self.doc[broken_word], 0, len(texts)), long_[broken_word])
        caseless = (self.nk == UNCASED) | (k[np.maximum(b_all - 1, 0)] == UNCASED)
        width = np.where(caseless & (w <= WRAP), np.minimum(width[np.clip(self.doc, 0, len(texts))], NARROW), width[np.clip(self.doc, 0, len(texts))])
        self.fits = long_ < width - SLACK
        self.pk = k[np.maximum(b_all - 1, 0)]
        self.colon = _is(c[np.maximum(b_all - 1, 0)], ":：")
        self.nospace = cjk
        # Quotation: whether the quote closed here came before the words that report it.
        opens = np.flatnonzero(_is(c, "«“‘„「『"))
        if len(opens) and m:
            o = np.maximum(np.searchsorted(opens, b_all - 1) - 1, 0)
            o = np.where(opens[o] < b_all, opens[o], 0)
            pre = solid[np.maximum(np.searchsorted(solid, o) - 1, 0)]
            self.quote_first = self.quote & np.isin(k[pre], (STOP, CLOSE, SEP)) | (self.quote & (lines[o] > lines[np.minimum(pre + 1, n)]))
        else:
            self.quote_first = np.zeros(m, bool)
        self.to = c[nx] == 0x3068  # the particle that follows a reported sentence
        self.reported = self._reported()
        # A day before the name of a month, in a language that writes ordinals with a full stop.
        dated = np.flatnonzero(self.dot & self.digits & (self.nk == UPPER))
        self.month = np.zeros(m, bool)
        to = nx[dated]
        edges = np.flatnonzero(~wordy)
        till = edges[np.minimum(np.searchsorted(edges, to), len(edges) - 1)] if len(edges) else to
        self.month[dated] = np.isin(hash_words(lc, to, till), _months())
        after = k[np.minimum(nx + 1, n - 1)]
        self.next_low = np.isin(after, (LOWER, SPACE, LINE))  # a capital that starts a word, or is one
        self.bare = _unpunctuated(c[np.maximum(b_all - 1, 0)]) & _unpunctuated(nc)
        self.near_bare = _unpunctuated(c[np.maximum(b_all - 1, 0)]) | _unpunctuated(nc)
        self.kg = _is(nc, "K") & (_is(c[np.minimum(nx + 1, n - 1)], "G"))

    def _reported(self) -> np.ndarray:
        """Whether a place lies inside a quotation whose reporting words follow its closing mark or precede a colon."""
        c, k, b = self.c, self.k, self.b
        opens, closes = np.flatnonzero(_is(c, "«“「『")), np.flatnonzero(_is(c, "»”」』"))
        if not len(opens) or not len(closes) or not len(b):
            return np.zeros(len(b), bool)
        far = len(c) - 4
        i, j = np.searchsorted(opens, b), np.searchsorted(closes, b)
        o, before = np.where(i > 0, opens[np.maximum(i - 1, 0)], -1), np.where(j > 0, closes[np.maximum(j - 1, 0)], -1)
        q, after = np.where(j < len(closes), closes[np.minimum(j, len(closes) - 1)], far), np.where(i < len(opens), opens[np.minimum(i, len(opens) - 1)], far)
        doc = np.clip(self.doc, 0, len(self.bounds) - 2)
        inside = (o > before) & (o > self.bounds[doc]) & (q < after) & (q < self.bounds[doc + 1])
        q = np.minimum(q, far)
        told = (k[q + 1] == COMMA) | (k[q + 1] == SPACE) & ((k[q + 2] == LOWER) | (k[q + 2] == COMMA)) | (c[q + 1] == 0x3068)
        lead = np.where(k[np.maximum(o - 1, 0)] == SPACE, o - 2, o - 1)
        return inside & (told | _is(c[np.maximum(lead, 0)], ":："))

    def _listed(self) -> np.ndarray:
        """Whether a list mark starts at a place."""
        c, k = self.c, self.k
        blank = np.concatenate((np.isin(k[1:], (SPACE,)), [False]))
        out = _is(c, BULLETS) & blank
        close = _is(c, ".)")
        after = lambda x, j: np.concatenate((x[j:], np.zeros(j, x.dtype)))
        digit = k == DIGIT
        out |= digit & after(close, 1) & after(k == SPACE, 2)
        out |= digit & after(digit, 1) & after(close, 2) & after(k == SPACE, 3)
        out |= (c == 40) & after(digit, 1) & after(c == 41, 2)
        return out

    def features(self, dots: np.ndarray) -> np.ndarray:
        """Indices into the table of weights, a row per place and a column per view: the marks with what follows; the word
        before; its shape; the letters after; quotation; layout; letters on both sides in scripts without stops; listed
        abbreviations; how often the word before carries a dot in the sample (``dots``, by hash); and what holds in any
        script, so that marks and scripts the sample lacks are still read."""
        c, b, nx = self.c, self.b, self.next

        def code(*xs: np.ndarray) -> np.ndarray:
            out = np.zeros(len(b), np.uint64)
            for x in xs:
                out = out * np.uint64(16) + np.minimum(x, 15).astype(np.uint64)
            return out

        with np.errstate(over="ignore"):
            # A break where the line was full is as good as a blank.
            gap = np.where(self.stop & (self.gap == 2) & ~self.fits, 1, self.gap)
            last = np.where(self.stop, 0, np.where(np.isin(self.pk, (LOWER, UPPER, DIGIT)), LOWER, self.pk))
            kind = np.where(~self.stop, 0, np.where(self.dot, 1, np.where(self.ellipsis, 2, np.where(self.full, 3, 4))))
            side = code(kind, self.nk, gap)
            length = np.minimum(self.head - self.start, 6)
            before = self.k[np.maximum(self.head - 1, 0)]
            tail = np.zeros(len(b), np.uint64)
            for j in range(3):
                tail = tail * np.uint64(0x10001) + c[np.minimum(nx + j, len(c) - 1)]
            front = np.zeros(len(b), np.uint64)
            for j in range(1, 4):
                front = front * np.uint64(0x10001) + c[np.maximum(b - j, 0)]
            list_mark = self.mark.astype(int) + 2 * self.month + 4 * self.kg
            rows = [
                code(kind, self.nk, gap, last, self.nospace, self.quote, self.final),
                self.word * np.uint64(31) + side,
                code(kind, self.nk, gap, length, before, self.inner, self.next_low),
                tail * np.uint64(4099) + side,
                code(kind, self.nk, gap, self.quote, self.round, self.quote_first, self.to, self.reported, last),
                code(kind, self.nk, gap, self.fits, self.colon, self.entry, self.next_entry, self.near_bare, last, list_mark, self.final),
                np.where(self.near_bare, (front * np.uint64(0x1000193) ^ tail) * np.uint64(2) + self.bare, np.uint64(1)),
                code(kind, self.nk, gap, self.name, self.number, self.initial, self.letter, self.digits, self.quote, self.final),
                code(kind, self.nk, gap, dots[(self.word >> np.uint64(64 - DOT_BITS)).astype(np.int64)], np.minimum(length, 4)),
            ]
            start = np.isin(self.nk, (UPPER, UNCASED, OPEN, DIGIT, DASH, OTHER))
            strong = self.stop & ~self.dot & ~self.ellipsis
            title = self.name | self.initial | self.letter
            rows.append(code(strong + 2 * self.dot + 4 * self.ellipsis, np.where(start, UPPER, self.nk), self.reported | self.quote & (self.to | self.quote_first), title & self.dot, (self.gap > 0) & (self.dot | self.ellipsis | ~self.stop), self.bare & ~self.stop))
            mixed = [((r + np.uint64(i)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 18) for i, r in enumerate(rows)]
        return np.stack(mixed, 1).astype(np.int64)

    def certain(self) -> np.ndarray:
        """Labels by what punctuation and layout show; the model is fitted to these."""
        nk, gap = self.nk, self.gap
        low, up = nk == LOWER, np.isin(nk, (UPPER, OPEN, DASH, OTHER))
        quiet = nk == UNCASED
        digit = nk == DIGIT
        title = self.name | self.initial | (self.letter & self.dot)
        y = np.zeros(len(self.b), bool)
        # A stop, then a blank or a line break.
        plain = self.stop & (gap >= 1)
        y |= plain & (up | digit | quiet)
        y &= ~(self.dot & ~self.quote & title & ~self.final)
        y &= ~(self.dot & self.number & digit)
        y &= ~(self.dot & self.kg)
        y &= ~self.month
        y &= ~(self.ellipsis & (low | quiet))
        # A stop and no blank: scripts that need none, or a blank left out.
        tight = self.stop & (gap == 0) & ~self.ellipsis
        y |= tight & self.full & ~np.isin(nk, (COMMA, CLOSE, STOP))
        y |= tight & ~self.full & ~self.dot & (quiet | up)
        y |= tight & self.dot & (nk == UPPER) & self.next_low & (np.isin(self.k[np.maximum(self.head - 1, 0)], (LOWER, DASH, CLOSE)) | self.inner | self.digits) & ~title
        y |= tight & self.dot & (nk == OPEN) & (self.pk == STOP) & ~title
        # Words that report a quotation belong to it.
        y &= ~(self.quote & quiet & (self.quote_first | self.to))
        y &= ~(self.reported & self.stop & (gap < 3))
        y &= ~(self.stop & np.isin(nk, (COMMA, CLOSE)))
        y &= ~(self.stop & low)
        # Line breaks without a stop.
        bare_line = ~self.stop & (gap == 2)
        y |= bare_line & self.fits & ~(low & ~self.entry) & ((self.pk != COMMA) | self.colon)
        y |= bare_line & self.next_entry
        y |= self.stop & (gap == 2) & self.next_entry
        y &= ~self.mark
        # Blanks in scripts without full stops.
        y |= ~self.stop & (gap == 1) & self.bare
        y |= self.near_bare & self.stop & (gap >= 1) & ~self.dot
        y |= (gap == 3) | self.final
        return y


def _lower(c: np.ndarray) -> np.ndarray:
    """Code points of Latin letters in lower case without accents; others as they are."""
    return _lower_table()[np.minimum(c, 0xFFFF)]


@lru_cache(1)
def _lower_table() -> np.ndarray:
    t = np.arange(0x10000, dtype=np.uint32)
    for i in range(0x250):
        t[i] = ord(unicodedata.normalize("NFKD", chr(i).lower())[0])
    return t


#: Sentences in scripts that a sample may lack; the model is always fitted to these too.
SEED = (
    "今天下雨。水渠坏了。谁来修？村民说：“我们去修。”大家同意了！会议……没有开始。“够了！”人们喊道。",
    "今日は雨です。水路が壊れた。誰が直すのか？「私が直す。」と村長は言った。会議は……終わった。皆が帰った！",
    "आज बारिश हुई। नहर टूट गई। कौन ठीक करेगा? डॉ. राव और श्री. सेन आए। लोग चले गए।",
    "نزل المطر اليوم. من يصلح القناة؟ جاء د. سالم وأ. هند. الاجتماع... لم ينته. ذهب الناس.",
    "วันนี้ฝนตก คลองพังแล้ว ใครจะซ่อม ชาวบ้านมา 12 คน  ทุกคนกลับบ้าน น้ำลึก 3.5 เมตร เด็กเล่นน้ำ",
    "ມື້ນີ້ຝົນຕົກ ຄອງເພແລ້ວ ຊາວບ້ານມາ 12 ຄົນ ທຸກຄົນກັບບ້ານ",
    "ថ្ងៃនេះភ្លៀង។ ប្រឡាយខូច។ អ្នកភូមិមក ១២ នាក់។ ពួកគេទៅផ្ទះ។",
    "Сегодня дождь. Канал сломан. Кто починит? Пришли 12 человек. Все ушли!",
    "Σήμερα βρέχει. Το κανάλι χάλασε. Ποιος θα το φτιάξει; Ήρθαν όλοι. Έφυγαν!",
    "Canal y riego\nLa carta pide:\n1. Medir el agua\n2) Citar a Eva\n- Cerrar la toma\nLlovió hoy. Vino el Sr. Soto.Nadie habló.",
    "Nota del valle\nSe acordó:\n- Limpiar el canal\n* Pagar a Rosa\n1) Pedir datos\n2. Abrir la toma\nTodos firmaron.Luego se fueron. Llovía.",
    "The valley\nThey agreed:\n• Clean the canal\n1. Pay Rose\n2. Open the gate\nAll signed.Then they left. It rained.",
    "Por la mañana los vecinos del valle y sus familias limpiaron el canal que\npasa por el pueblo. A mediodía, después de la reunión, Rosa Vera subió a la\nSierra Alta. Nadie la vio volver, según contó por la tarde su hermano\nJuan. Después llovió.",
    "In the morning the people of the valley and their families cleaned the\ncanal. At noon, after the meeting, Rose Hill climbed up to the\nUpper Ridge. Nobody saw her come back, as her brother told us, said\nJohn. Then it rained.",
    "«Llueve. No saldré. Mañana veremos», dijo Rosa. Nadie rió. «Es tarde. Hay que irse», contestó Juan. Se fueron.",
    "“It rains. I stay. We shall see”, said Rose. Nobody laughed. “It is late. Let us go”, said John. They left.",
)


def _stripped(text: str, ends: np.ndarray) -> tuple[str, np.ndarray]:
    """A text without stops and the marks that close with them, and where ``ends`` (places of the text) then lie."""
    chars = np.array(list(text))
    keep = ~np.isin(chars, list(STOPS + CLOSERS))
    place = np.concatenate(([0], np.cumsum(keep)))
    return "".join(chars[keep]), place[ends]


class Model:
    """Weights of features, and of neighbouring tags by distance.

    Fitted to the labels that marks and layout show (``certain``). In every round each view of a place is hidden at random,
    so that words, shapes and letters learn what the marks show and stand in for them where marks mislead. Texts in scripts
    without full stops are fitted without any: their labels are those of the text as written, carried over to its
    stripped form by position. ``views`` leaves views out (for ablations).
    """

    def __init__(self, texts: list[str], rounds: int = 16, rate: float = 0.5, hidden: float = 0.2, views: tuple[int, ...] = tuple(range(VIEWS))):
        texts = [*texts, *SEED]
        whole = [Places(x) for _, x in chunks(texts)]
        self.dots = self._dots(whole)
        parts = [(p, p.certain()) for p in whole]
        bare, ends = [], []
        for t in texts:
            if _unpunctuated(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)).any():
                p = Places([t])
                s, e = _stripped(t.replace(_END, " "), p.b[p.certain()] - 1)
                bare.append(s)
                ends.append(e)
        for first, x in chunks(bare):
            p = Places(x)
            base = p.bounds[np.clip(p.doc, 0, len(x) - 1)] + 1
            shown = {(k, int(e)) for k in range(len(x)) for e in ends[first + k]}
            parts.append((p, np.array([(int(d), int(at)) in shown for d, at in zip(p.doc, p.b - base)], bool)))
        f = np.concatenate([p.features(self.dots) for p, _ in parts]) if parts else np.zeros((0, VIEWS), np.int64)
        y = np.concatenate([label for _, label in parts]).astype(np.float64) if parts else np.zeros(0)
        use = np.isin(np.arange(VIEWS), views)
        w, seen = np.zeros(TABLE), np.zeros(TABLE)
        np.add.at(seen, f.ravel(), 1)
        step = rate / np.sqrt(np.maximum(seen, 1))
        order = np.random.RandomState(7)
        for _ in range(rounds):
            p = order.permutation(len(y))
            for a in range(0, len(p), 256):
                i = p[a : a + 256]
                on = (order.random_sample((len(i), VIEWS)) >= hidden) & use
                err = y[i] - 1 / (1 + np.exp(-(w[f[i]] * on).sum(1)))
                np.add.at(w, f[i], err[:, None] * on * step[f[i]])
        self.w, self.use = w.astype(np.float32), use
        # Neighbouring tags: how much more often a pair occurs at a distance than its tags would by chance.
        count = np.ones((8, 2, 2))
        for place, label in parts:
            same = place.doc[1:] == place.doc[:-1]
            d = self.distance(place.b)[1:][same]
            np.add.at(count, (d, label[:-1][same].astype(int), label[1:][same].astype(int)), 1)
        joint = count / count.sum((1, 2), keepdims=True)
        self.tie = TIE * np.log(joint / (joint.sum(2, keepdims=True) * joint.sum(1, keepdims=True)))

    @staticmethod
    def _dots(parts: list[Places]) -> np.ndarray:
        """For each hash of a word: 0 if hardly seen, else 1 to 6 by the share of its occurrences that a dot follows where
        no sentence can end (a small letter, digit or comma comes next)."""
        seen, dotted = np.zeros(1 << DOT_BITS), np.zeros(1 << DOT_BITS)
        for p in parts:
            wordy = np.isin(p.k, (LOWER, UPPER, UNCASED))
            starts = np.flatnonzero(wordy[1:] & ~wordy[:-1]) + 1
            stops = np.flatnonzero(wordy[:-1] & ~wordy[1:]) + 1
            h = hash_words(_lower(p.c), starts, stops[: len(starts)]) if len(starts) else np.zeros(0, np.uint64)
            np.add.at(seen, (h >> np.uint64(64 - DOT_BITS)).astype(np.int64), 1)
            sure = p.dot & ~p.quote & np.isin(p.nk, (LOWER, DIGIT, COMMA))
            np.add.at(dotted, (p.word[sure] >> np.uint64(64 - DOT_BITS)).astype(np.int64), 1)
        share = dotted / np.maximum(seen, 1)
        return np.where(seen < 3, 0, 1 + np.minimum((share * 10).astype(int), 5)).astype(np.uint8)

    @staticmethod
    def distance(b: np.ndarray) -> np.ndarray:
        d = np.diff(b, prepend=b[:1])
        return np.minimum(np.log2(np.maximum(d, 1)).astype(int), 7)

    def decode(self, p: Places) -> np.ndarray:
        """The best tags of every text's chain. Chains advance together, one place per step."""
        m = len(p.b)
        if not m:
            return np.zeros(0, bool)
        score = self.w[p.features(self.dots)][:, self.use].sum(1).astype(np.float64)
        score[p.final] = 1e6  # a text ends its last sentence
        doc, first, length = np.unique(p.doc, return_index=True, return_counts=True)
        dist = self.distance(p.b)
        order = np.argsort(-length, kind="stable")
        first, length = first[order], length[order]
        best = np.zeros((len(doc), 2))
        best[:, 1] = score[first]
        back = np.zeros((m, 2), np.int8)
        alive = np.searchsorted(-length, -np.arange(1, length[0] + 1), "right")
        for t in range(1, length[0]):
            live = alive[t]
            i = first[:live] + t
            way = best[:live, :, None] + self.tie[dist[i]]
            back[i] = way.argmax(1)
            top = way.max(1)
            top[:, 1] += score[i]
            best[:live] = top
        tags = np.zeros(m, np.int8)
        now = best.argmax(1)
        for t in range(length[0] - 1, -1, -1):
            live = alive[t]
            i = first[:live] + t
            tags[i] = now[:live]
            now[:live] = back[i, now[:live]]
        return tags.astype(bool)


def spans(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first code point, one past the last) of each sentence, in order."""
    p = Places(texts)
    end = p.b[model.decode(p)]
    doc = np.searchsorted(p.bounds, end - 1, "right") - 1
    base = p.bounds[doc] + 1
    new = np.ones(len(end), bool)
    new[1:] = doc[1:] != doc[:-1]
    after = np.where(new, base, np.concatenate(([0], end[:-1])))
    start = p.solid[np.minimum(np.searchsorted(p.solid, after), len(p.solid) - 1)]
    keep = start < end
    return doc[keep], (start - base)[keep], (end - base)[keep]


def fit(documents: DataFrame, text: str, sample: int = SAMPLE) -> Model:
    """The model fitted on about ``sample`` different texts: those whose hash falls into one of as many parts as leave
    that number, and of these the ``2 * sample`` first by hash, so that every run draws the same."""
    share = max(1, documents.count() // max(sample, 1))
    rows = documents.select(F.col(text).alias("t")).where("t is not null and length(t) > 0").withColumn("h", F.xxhash64("t"))
    rows = rows.where(F.pmod("h", F.lit(share)) == 0).distinct().orderBy("h").limit(2 * sample)
    return Model(sorted(r["t"] for r in rows.collect()))


def split_sentences(documents: DataFrame, key: str, text: str, sample: int = SAMPLE) -> DataFrame:
    """One row ``(key, inicio, fin)`` per sentence of every text: first code point (from 0) and one past the last,
    blanks and line breaks around it left out, closing marks and quotes included.

    Null, empty and blank texts have no sentence; a text without any mark is one sentence. Repeated rows add nothing.
    Columns other than the two aren't read. Only the sample for fitting, about ``sample`` texts, reaches the driver.
    """
    kind = documents.schema[key].dataType.simpleString()
    model = documents.sparkSession.sparkContext.broadcast(fit(documents, text, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, part in chunks(batch.column(1).to_pylist()):
                doc, a, b = spans(model.value, part)
                keys = batch.column(0).take(pa.array(doc + first, pa.int64()))
                yield pa.RecordBatch.from_arrays([keys, pa.array(a, pa.int32()), pa.array(b, pa.int32())], [key, "inicio", "fin"])

    return documents.select(key, text).mapInArrow(run, f"`{key}` {kind}, inicio int, fin int").distinct()
