"""Pages made of keywords, links or tags instead of sentences.

Every line is reduced to a shape: its words in a few bands, its share of capitals, its separators, its links and its end.
The lines of a page are grouped by shape; a page is spam if the shapes of links, tags and keywords together hold more than half
of its text. A stop doesn't make a sentence: a line with one needs words that only sentences have, and a sentence whose own
words come again and again has a shape of stuffed keywords. A text is looked at where it lies, so nothing is shuffled.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tausift.llm.pairs import FUNCTION_WORDS
from tausift.llm.tokens import visible

#: Share of a page's characters (blanks don't count) that spam shapes must hold.
MORE_THAN = 0.5
#: Plain words without separators count as keywords if this share of them repeats words of the same page's keyword lines.
REPEATED = 0.4
#: Share of function words from which lines of plain words are wrapped sentences.
PROSE = 0.28
#: Share of a sentence's content words that repeat others of it, from which it is stuffed, and the words that takes.
STUFFED, LEAST_WORDS = 0.45, 4
#: Words over which repetition is measured, so that long texts don't repeat more than short ones.
STRETCH = 24
#: Share of function words (of kana among Japanese characters) from which words with a stop are a sentence.
SENTENCE_WORDS, SENTENCE_KANA = 0.1, 0.17
#: Sentences under this share of the numbered links below them are no article, and the links are the page.
ARTICLE = 0.25
#: Lines that a shape of links, tags or keywords needs, unless one line alone is a list of as many entries.
LEAST_LINES = 3

_FUNCTION_WORDS = frozenset(w for words in FUNCTION_WORDS.values() for w in words)
_LINES = re.compile(r"\r\n|[\r\n\x85  ]")
_ANCHOR = re.compile(r"<a\s[^>]*>(.*?)</a>", re.IGNORECASE)
_TAG = re.compile(r"</?[a-zA-Z][^>]*>|&nbsp;")
_URL = re.compile(r"\[[^\]\n]*\]\([^)\s]*\)|(?:https?://|www\.)\S+|\b[\w-]+(?:\.[\w-]+)+/\S*")
_REFERENCE = re.compile(r"\s*(?:\[\d+\]|\d+\.|\^\d*|\(\d+\))\s*:?\s*(?:https?://|www\.)\S+\s*$")
_AMOUNT = re.compile(r"[:：,，]\s*[^\W\d_]{0,4}[\d.,]+\s*\S{0,4}\s*$")
_SENTENCE_END = re.compile(r"[.。．!?！？।…:：][\"'”’»」』）)\]*_\s]*$")
_SENTENCE_IN = re.compile(r"[。！？।]|[.!?](?=\s+\S)")
_SEPARATOR = re.compile(r"\s[/|·•»›>–—-]+\s|[|·•»›;、,]\s*|\s?/\s?")
_WORD = re.compile(r"[^\W_][^\s,;、|/·•»#()\[\]]*")
_HASHTAG = re.compile(r"(?<!\S)#[^\s#]+")
_DOMAINS = re.compile(r"(?:[-*•]\s*|\d+[.)]\s*)?(?:(?:[\w-]{2,}\.)+[a-zA-Z]{2,24}[,;]?\s*)+$")
_RUN = re.compile(r"[ァ-ヺー]{2,}|[㐀-鿿豈-﫿々〇]{2,}|[a-z]{2,}")
_EDGES = " \t.,;:!?।…\"'’“”«»()[]<>|/*_#&%+=~–—-0123456789"
_JAPANESE = re.compile(r"[぀-ヿ㐀-鿿]+")
_KANA = re.compile(r"[ぁ-ん]+")
_STRETCH_END = re.compile(r"[。！？।!?]+|\.(?=\s|$|[^\W\d_a-z])")
_JAPANESE = re.compile(r"[぀-ヿ㐀-鿿]+")
_KANA = re.compile(r"[ぁ-ん]+")
_NUMBER_CELL = re.compile(r"[\s\d.,%:+-]*$")
_COUNTED = re.compile(r"\s*\S.{0,60}\(\d+\)\s*$")


def line_shape(line: str) -> tuple[str, str]:
    """(class, shape) of one line without invisible characters; class is one of the keys below.

    sentence, heading, figures (a table row of numbers), amounts (`name: company, 12`), reference (a numbered link),
    links, tags, words (short entries without separators), stopped (words with a stop that don't read as a sentence), blank.
    """
    text = line.strip()
    if not text:
        return "blank", ""
    if text[0] == "#" and text.lstrip("#")[:1] in (" ", "\t", "　"):
        return "heading", "heading"
    if _REFERENCE.match(text):
        return "reference", "reference"
    anchors = len(_ANCHOR.findall(text))
    bare = _TAG.sub(" ", _ANCHOR.sub(" ", text)) if anchors else _TAG.sub(" ", text) if "<" in text else text
    links = anchors + len(_URL.findall(bare)) if "/" in bare or "www." in bare or anchors else 0
    if links:
        rest = _URL.sub(" ", bare)
        words = len(_WORD.findall(rest))
        outside = sum(map(str.isalpha, rest))
        if words <= 8 * links and (outside <= 40 * links) and not (_SENTENCE_IN.search(rest) and outside > 25):
            return "links", f"links{min(links, 3)}:{'*' if text[0] in '*-' else '9' if text[0].isdigit() else 'u'}"
    if "." in text and _DOMAINS.match(text):
        return "links", "domains"
    cells = [c for c in text.strip("|").split("|")]
    if text[0] == "|" or len(cells) > 2:
        numeric = sum(bool(_NUMBER_CELL.match(c)) for c in cells)
        if numeric * 2 >= len(cells):
            return "figures", "figures"
    if _AMOUNT.search(text) and (text[0] in "-*•" or ":" in text or "：" in text):
        return "amounts", "amounts"
    stop = bool(_SENTENCE_END.search(text) or _SENTENCE_IN.search(text))
    hashtags = len(_HASHTAG.findall(text)) if "#" in text else 0
    if stop and hashtags < 3 and _reads(text):
        return "sentence", "sentence"
    words = _WORD.findall(text)
    band = 1 if len(words) < 4 else 2 if len(words) < 9 else 3 if len(words) < 21 else 4
    capitals = sum(w[0].isupper() for w in words) * 2 >= len(words) > 0
    if hashtags >= 3 and hashtags * 2 >= len(words):
        return "tags", f"hash{band}"
    if stop and hashtags >= 3 and _reads(text):
        return "sentence", "sentence"
    if _COUNTED.match(text) and len(words) <= 8:
        return "tags", f"counted{band}"
    parts = [p for p in _SEPARATOR.split(text) if p.strip()]
    if len(parts) >= 3 and max(len(_WORD.findall(p)) for p in parts) <= 5 and sum(map(len, parts)) <= 32 * len(parts):
        marks = "".join(sorted({m.strip() for m in _SEPARATOR.findall(text)} - {""}))
        return "tags", f"list{min(len(parts), 9)}{marks}{'C' if capitals else ''}"
    if stop:
        return "stopped", f"stopped{band}{'C' if capitals else ''}"
    ends = "9" if text[-1].isdigit() else "a"
    return "words", f"words{band}{'C' if capitals else ''}{ends}"


def _reads(text: str) -> bool:
    """Whether words with a stop read as a sentence: by kana between Japanese characters, by function words elsewhere."""
    japanese = 0 if text.isascii() else sum(map(len, _JAPANESE.findall(text)))
    if japanese * 3 > len(text):
        parts = text.split()
        if len(parts) >= 3 and japanese <= 6 * len(parts):
            return False
        return sum(map(len, _KANA.findall(text))) >= SENTENCE_KANA * japanese
    words = text.casefold().split()
    return sum(map(_FUNCTION_WORDS.__contains__, words)) >= SENTENCE_WORDS * len(words)


def _content(text: str) -> list[str]:
    """The words of a text that aren't function words or numbers; two characters at a time in scripts without blanks."""
    if text.isascii() or not _JAPANESE.search(text):
        return [w for x in text.split() if (w := x.strip(_EDGES)) and w not in _FUNCTION_WORDS]
    out: list[str] = []
    for w in _RUN.findall(text):
        if w[0] < "゠":
            out.append(w)
        else:
            out += [w[k : k + 2] for k in range(len(w) - 1)]
    return out


def _repeats(words: list[str]) -> float:
    """The share of words that repeat others, at most STRETCH words apart: the mean over stretches of that length."""
    if not words:
        return 0.0
    parts = -(-len(words) // STRETCH)
    size = -(-len(words) // parts)
    return 1 - sum(len(set(words[k : k + size])) for k in range(0, len(words), size)) / len(words)


def _stuffed_chars(shaped: list[tuple[tuple[str, str], str]]) -> list[int]:
    """How many characters (blanks don't count) of each line are in stuffed sentences, which may run over several lines.

    Stuffed are sentences that repeat their own words, and those made of the words that the page's stuffed sentences repeat.
    """
    sentences: list[tuple[list[int], int, int, list[str], bool]] = []
    texts: list[str] = []
    k = 0
    while k < len(shaped):
        end = k
        while end < len(shaped) and shaped[end][0][0] in ("sentence", "words", "stopped"):
            end += 1
        if end > k:
            text, starts, at = "\n".join(line for _, line in shaped[k:end]), [k], 0
            for _, line in shaped[k:end]:
                starts.append(at)
                at += len(line) + 1
            a = 0
            for b in [*(m.end() for m in _STRETCH_END.finditer(text)), len(text)]:
                words = _content(text[a:b].casefold())
                if words:
                    sentences.append((starts, a, b, words, len(words) >= LEAST_WORDS and _repeats(words) >= STUFFED))
                    texts.append(text)
                a = b
        k = end + 1
    out = [0] * len(shaped)
    if not any(stuffed for *_, stuffed in sentences):
        return out
    repeated = Counter(w for *_, words, stuffed in sentences if stuffed for w, n in Counter(words).items() if n > 1)
    keywords = {w for w, n in repeated.items() if n > 1}
    for text, (starts, a, b, words, stuffed) in zip(texts, sentences, strict=True):
        if not stuffed and sum(w in keywords for w in words) < STUFFED * len(words):
            continue
        k = bisect_right(starts, a, 1) - 1
        while k < len(starts) and starts[k] < b:
            stop = starts[k + 1] if k + 1 < len(starts) else len(text)
            out[starts[0] + k - 1] += len("".join(text[max(a, starts[k]) : min(b, stop)].split()))
            k += 1
    return out


def _entries(kind: str, line: str) -> int:
    """How many entries a line of links, tags or words lists."""
    if kind == "links" and not _URL.search(line):
        return max(1, len(_ANCHOR.findall(line)), line.count(".") if _DOMAINS.match(line.strip()) else 0)
    if kind == "links":
        return len(_ANCHOR.findall(line)) + len(_URL.findall(_ANCHOR.sub(" ", line)))
    if kind == "tags":
        return max(len(_HASHTAG.findall(line)), len([p for p in _SEPARATOR.split(line) if p.strip()]))
    return len(_WORD.findall(line))


def _wrapped_prose(shaped: list[tuple[tuple[str, str], str]]) -> None:
    """Makes sentences of runs of plain lines that touch a broken sentence: one that goes on behind the line's end, or that
    begins in the middle. Lines of keywords stand beside whole sentences only."""
    k = 0
    while k < len(shaped):
        if shaped[k][0][0] != "words":
            k += 1
            continue
        end = k
        while end < len(shaped) and shaped[end][0][0] == "words":
            end += 1
        for at in (k - 1, end):
            if 0 <= at < len(shaped) and shaped[at][0][0] == "sentence":
                line = shaped[at][1].strip().lstrip("> ")
                if not _SENTENCE_END.search(line) or line[:1].islower():
                    shaped[k:end] = [(("sentence", "sentence"), x) for _, x in shaped[k:end]]
                    break
        k = end


def _short_lines(lines: dict[tuple[str, str], list[str]], words: Counter[str]) -> bool:
    """Whether all lines of plain words are short and many of their words come up again."""
    short = all(shape[5] in "12" for kind, shape in lines if kind == "words")
    return short and sum(n for n in words.values() if n > 1) >= REPEATED * sum(words.values())


def _shaped(text: str) -> list[tuple[tuple[str, str], str]]:
    """(class and shape, line) of every line; three or more hashtags of a line are a line of their own."""
    shaped = []
    for line in _LINES.split(visible(text)):
        tags = _HASHTAG.findall(line) if "#" in line else []
        rest = _HASHTAG.sub(" ", line) if len(tags) >= 3 else ""
        if _WORD.search(rest):
            shaped += [(("tags", f"hash{min(len(tags), 9)}"), " ".join(tags)), (line_shape(rest), rest)]
        else:
            shaped.append((line_shape(line), line))
    return shaped


def spam_share(text: str) -> tuple[float, list[str]]:
    """The share of the text (characters but for blanks and invisible ones) in spam shapes, and those shapes, largest first."""
    chars: Counter[tuple[str, str]] = Counter()
    lines: defaultdict[tuple[str, str], list[str]] = defaultdict(list)
    shaped = _shaped(text)
    _wrapped_prose(shaped)
    for (shape, line), stuffed in zip(shaped, _stuffed_chars(shaped), strict=True):
        size = len("".join(line.split()))
        chars[shape] += size - stuffed
        if stuffed:
            chars["stuffed", "stuffed"] += stuffed
            lines["stuffed", "stuffed"].append(line)
        if shape[0] in ("links", "tags", "words", "stopped", "reference") and 2 * stuffed < size:
            lines[shape].append(line)
    total = sum(chars.values())
    if not total or not lines:
        return 0.0, []
    if chars["sentence", "sentence"] >= ARTICLE * chars["reference", "reference"]:
        lines.pop(("reference", "reference"), None)
    words = Counter(w.casefold() for (kind, _), group in lines.items() if kind == "words" for line in group for w in _WORD.findall(line))
    count = sum(words.values())
    prose = sum(n for w, n in words.items() if w in _FUNCTION_WORDS) >= PROSE * count  # lines of wrapped sentences
    keywords = count >= 8 and not prose and (1 - len(words) / count >= REPEATED or _short_lines(lines, words))
    stopped = [w for (kind, _), group in lines.items() if kind == "stopped" for line in group for w in _content(line.casefold())]
    repeated = len(stopped) >= 8 and _repeats(stopped) >= REPEATED
    of_kind: Counter[str] = Counter()
    for (kind, _), group in lines.items():
        of_kind[kind] += sum(max(1, _entries(kind, line)) if kind == "tags" and len(group) < LEAST_LINES else _entries(kind, line) if kind == "links" else 1 for line in group)
    alone = {"words": keywords, "stopped": repeated, "stuffed": True}
    spam = [s for s in lines if alone.get(s[0], of_kind[s[0]] >= LEAST_LINES)]
    spam = sorted(spam, key=lambda s: (-chars[s], s))
    return sum(chars[s] for s in spam) / total, [s[1] for s in spam]


def keyword_pages(df: DataFrame, item: str, text: str) -> DataFrame:
    """(item, spam_share, shapes, is_spam) for every row.

    spam_share: part of the text in links, tags or repeated keywords, be they lines or sentences stuffed with them; is_spam: it is
    more than half. Tables of figures, sentences (numbered or not), companies with amounts, headings and numbered link references
    under an article are no spam. Null
    and blank texts have share 0. One row out per row in, repeated rows too; other columns of df are ignored.
    """
    rows = df.select(F.col(item).alias("__item"), F.col(text).alias("__text"))
    kind = rows.schema["__item"].dataType.simpleString()

    def look(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [spam_share(t) if t else (0.0, []) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([s for s, _ in found], pa.float64()), pa.array([x for _, x in found], pa.list_(pa.string())), pa.array([s > MORE_THAN for s, _ in found])],
                names=["__item", "spam_share", "shapes", "is_spam"],
            )

    return rows.mapInArrow(look, f"__item {kind}, spam_share double, shapes array<string>, is_spam boolean").withColumnRenamed("__item", item)
