"""Defects of question-answer pairs: empty, copied, refusing, wrong-language and truncated answers.

A pushdown parser reads fences, brackets, quotations, markup and lists and says what is still open at the end. Greedy
string tiling finds answers made of their question, its runs found by a suffix automaton of the question. Script counts and
function words name the language of sentences. A small grammar reads refusals. No rule depends on the length of a text. Where a text stops without a mark and with nothing open, counts over all answers and
references tell whether sentences end on such words: the last words of the text are looked up, with names and numbers as
placeholders, longest context first.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tausift.llm.filters import HashFilter, hash_filter
from tausift.llm.tokens import tokens, visible
from tausift.runtime import cut, small

# ---- fixed values: words and marks of the languages that are read ----

NO_VALUE = frozenset("null none nan nil n/a na n.a. n.d. nd undefined unknown empty vuoto nessuno tbd todo なし 無し 無 該当なし 未回答 空欄 不明 ない कुछ_नहीं लागू_नहीं रिक्त शून्य उपलब्ध_नहीं".replace("_", " ").split(" "))
LABELS = frozenset("content question domanda quesito query q a answer risposta prompt text testo mi chiedi lei chiede la è il tuo sua hai chiesto प्रश्न सवाल आपका आपका_प्रश्न है आपने पूछा question: frage pregunta".split())
JA_LABELS = re.compile(r"質問|ご質問|お尋ね|問い|というご|ですね|です|でしょうか|という|との|こと|です|「|」|[ごとはのいうねす]")
FUNCTION_WORDS = {
    "it": "il lo la i gli le un una di del della dei delle dello degli a al alla ai alle allo e ed o che chi è sono ha hanno non in nel nella nei nelle con per da dal dalla su sul sulla tra fra come più ma se cui si ne dopo prima stato stata entro oltre".split(),
    "en": "the a an of to and or in on at is are was were be been has have had not for with by from that which as it its this but if because so which up down out off before after".split(),
    "es": "el la los las un una de del y o en que es son fue fueron ha han no por para con al se su sus como más pero porque hasta año lo le subieron gracias".split(),
    "fr": "le la les un une de du des et ou en que qui est sont a été ont ne pas pour par avec au aux ce cette se sa son plus mais parce dans sur grâce à d' l'".split(),
    "de": "der die das ein eine und oder in im ist sind war wurde hat haben nicht für mit von zu zum zur auf den dem des weil auch sich als nach aus bei um".split(),
    "pt": "o a os as um uma de do da dos das e ou em no na que é são foi não por para com ao se seu sua como mais mas porque até".split(),
    "hi": "है हैं था थे थी का की के में से को ने और पर यह कि नहीं गया गई किया हुआ हुई रहा एक लिए ताकि".split(),
    "mr": "आहे आहेत होते होता होती आणि च्या ने ला नाही केले केली झाले झाली व हे ही हा मध्ये".split(),
    "ne": "छ छन् थियो थिए र को का की लाई ले मा भएको गरे गर्यो गरेको हो होइन यो".split(),
}
#: Words that no sentence ends with, whatever mark follows.
NEVER_LAST = frozenset("il lo la gli un una di del della dei delle dello degli al alla ai alle e ed o che con per da dal dalla nel nella nei nelle sul sulla tra fra perché poiché mentre quando come se anche ma oppure the an of to and or in on at with by from that which because but और या कि क्योंकि लेकिन तथा का की के में से को ने पर तो जो एवं".split())
NEVER_LAST_JA = ("および", "または", "ならびに", "ので", "ため、", "により", "によると", "について", "なぜなら", "しかし", "そして", "さらに", "その後", "一方", "また", "なお", "「", "は", "を", "に", "が", "の", "へ", "や")
COUNT_WORDS = {"due": 2, "tre": 3, "quattro": 4, "cinque": 5, "sei": 6, "two": 2, "three": 3, "four": 4, "five": 5, "दो": 2, "तीन": 3, "चार": 4, "पाँच": 5, "पांच": 5, "二つ": 2, "三つ": 3, "四つ": 4, "五つ": 5, "二点": 2, "三点": 3, "四点": 4, "五点": 5}

#: Grammar of refusals. `<name>` stands for another rule, a list for its alternatives. A text is a refusal if each of its
#: sentences derives from decline, regret or offer, and at least one from decline.
GRAMMAR = {
    "decline": ["<it_decline>", "<ja_decline>", "<hi_decline>", "<other_decline>"],
    "regret": ["<it_regret>", "<ja_regret>", "<hi_regret>", "<other_regret>"],
    "offer": ["<it_offer>", "<ja_offer>", "<hi_offer>", "<other_offer>"],
    # Italian: (I) + not + able, impossible to me, must or prefer + abstain
    "it_decline": [r"\bnon <it_able>\b", r"\b(?:mi|ci) è impossibile\b", r"\b(?:devo|dobbiamo) <it_abstain>\b", r"\b(?:preferisco|preferirei|preferiamo) (?:non|<it_abstain>)\b", r"\bmi (?:rifiuto|astengo)\b", r"\bdeclino\b"],
    "it_able": ["posso", "possiamo", "riesco", "intendo", "desidero", "voglio", "sono in grado", "siamo in grado", r"sono autorizzat\w", "mi è <it_allowed>", "ci è <it_allowed>"],
    "it_allowed": ["consentito", "possibile", "permesso", "dato"],
    "it_abstain": ["evitare", "astenermi", "astenerci", "rifiutare", "declinare", "rinunciare"],
    "it_regret": ["mi dispiace", "mi scus", "spiacente", "purtroppo", "con rammarico", "grazie per la domanda", r"in quanto (?:assistente|modello|ia\b)", "come (?:assistente|modello)"],
    "it_offer": ["posso aiutar", "si rivolga", "consult[ia]", "la invito", r"altro\?", "chieda", "professionist", "esperto", "mi scus", "grazie"],
    # Japanese: saying + cannot, may not or refrain
    "ja_decline": ["<ja_saying>[^。]{0,14}<ja_cannot>", "お断り(?:します|いたします|させて)"],
    "ja_saying": ["お答え", "回答", "お手伝い", "対応", "コメント", "申し上げ", "扱う", "取り扱", "お力", "提供", "言及", "判断", "お話し", "ご案内", "お伝え", "説明", "助言", "お役", "お応え"],
    "ja_cannot": ["でき(?:ません|かね)", "(?:いたし|し|致し)かね", "差し控え", "控え(?:させて|ます|る)", "られません", "なれません", "立てません", "かねます", "お断り", "辞退", "ありません", "遠慮"],
    "ja_regret": ["申し訳", "恐れ入りますが", "残念ながら", "AIとして", "ご質問ありがとう", "あいにく", "すみません"],
    "ja_offer": ["ご了承", "ご相談", "お知らせください", "お問い合わせ", "ご理解", "別の質問", "ありがとうございます", "お尋ねください"],
    # Hindi: first person + unable, not allowed, will not; or saying + first person + avoid
    "hi_decline": ["<hi_first>[^।]{0,60}<hi_cannot>", "<hi_saying> (?:की|में|से) (?:मुझे|मैं|हमें|हम)[^।]{0,30}(?:असमर्थ|अनुमति नहीं|बच|परहेज़|इनकार)", "(?:देना|करना|कहना|बताना|बोलना) (?:मेरे|हमारे) लिए (?:संभव|मुमकिन) नहीं"],
    "hi_first": ["मैं", "मुझे", "मेरे लिए", "हम", "हमें", "हमारे लिए"],
    "hi_saying": ["देने", "करने", "बताने", "कहने", "बोलने"],
    "hi_cannot": ["असमर्थ", "अनुमति नहीं", "संभव नहीं", "मुमकिन नहीं", r"नहीं (?:दे|कर|बता|कह)\s?(?:सक|पा)", "नहीं (?:दूँगा|दूंगा|दूँगी|करूँगा|करना चाह|देना चाह|कहना चाह)", "इनकार करत", "परहेज़", "बचना चाह"],
    "hi_regret": ["क्षमा", "माफ़", "माफ", "खेद है", "सवाल के लिए धन्यवाद", "एक एआई"],
    "hi_offer": ["कृपया", "सवाल हो", "पूछ(?:ें|िए)", "बताइए", "धन्यवाद", "विशेषज्ञ"],
    "other_decline": [r"\bI(?:'m| am) (?:unable|not able|not allowed|not permitted)", r"\bI (?:can(?:'|no)t|can not|won't|will not|must decline|have to decline|prefer not|would rather not)", r"\bno puedo\b", r"\bje ne peux pas\b", r"\bich kann (?:\w+ ){0,3}nicht\b"],
    "other_regret": ["sorry", "unfortunately", "as an ai", "as a language model", "lo siento", "désolé", "leider", "es tut mir"],
    "other_offer": ["contact", "consult", "anything else", "let me know", "understand"],
    # statements that the information is missing: of the information or the text as a whole, not of one detail
    "missing": ["<it_source>.*?<it_missing>", "non <it_missing_verb>", "nessuna informazione", "<ja_source>.*?<ja_missing>", "<ja_missing>", "<hi_source>.*?<hi_missing>", "(?:there is )?no information", "the (?:text|document|information|answer).*?not (?:mentioned|stated|provided|available|found)", "not (?:mentioned|stated|provided|available|found)"],
    "it_source": ["l['’]informazione", "le informazioni", "la risposta", "(?:il|i) dat[oi]", "(?:il|i|nel|nei|dal|dai) test[oi]", "(?:il|i|nel|nei|dal|dai) document[oi]", "(?:la|le|nella|nelle|dalla|dalle) font[ei]"],
    "it_missing": ["non è (?:present|indicat|riportat|possibile (?:saperlo|stabilirlo|ricavarlo|risalire))", "non <it_missing_verb>", "nessuna informazione"],
    "it_missing_verb": ["(?:lo )?(?:riporta|indica|menziona|dice|specifica)", "(?:vi|ci) sono informazioni", "risulta", "è possibile (?:saperlo|stabilirlo|ricavarlo|risalire)"],
    "ja_source": ["該当", "与えられ", "提供され", "文書", "資料", "本文", "この", "その", "ご?質問", "必要な", "関連する", "テキスト", "情報"],
    "ja_missing": ["見当たりません", "記載(?:が|は)(?:ありません|ない)", "分かりません", "わかりません", "不明です", "情報(?:が|は)ありません", "含まれていません"],
    "hi_source": ["ऐसी", "इस", "दस्तावेज़", "दी गई", "दिए गए", "उपलब्ध", "पाठ", "जानकारी", "यह", "कोई"],
    "hi_missing": ["पता नहीं चलता", "जानकारी नहीं", "उल्लेख नहीं", "नहीं (?:मिली|मिला|दी गई|बताया)"],
}


def _rule(name: str) -> str:
    """The pattern of a rule with the rules it names put in."""
    return "(?:" + "|".join(re.sub(r"<(\w+)>", lambda m: _rule(m.group(1)), x) for x in GRAMMAR[name]) + ")"


_DECLINE, _CLAUSE = re.compile(_rule("decline"), re.IGNORECASE), re.compile("|".join(map(_rule, ("decline", "regret", "offer"))), re.IGNORECASE)
_MISSING = re.compile(r"[\s\"'«「*_-]*" + _rule("missing"), re.IGNORECASE)

# ---- marks ----
_TAG = re.compile(r"</?([a-zA-Z][a-zA-Z0-9]*)[^<>]*?(/?)>")
_ENTITY = re.compile(r"&(?:nbsp|amp|lt|gt|quot|#\d+|#x[0-9a-f]+);", re.IGNORECASE)
_JSON = re.compile(r'\s*\{\s*"(\w+)"\s*:\s*"(.*)"\s*\}\s*$', re.DOTALL)
_JSON_OPEN = re.compile(r'\s*\{\s*"\w+"\s*:\s*"?')
_PAIRS = {"(": ")", "[": "]", "{": "}", "「": "」", "『": "』", "（": "）", "【": "】", "《": "》", "«": "»", "“": "”", "〔": "〕"}
_CLOSERS = {c: o for o, c in _PAIRS.items()}
_OPENER = re.compile("[" + re.escape("".join(_PAIRS)) + '<"]|```|[*][*]')
_MARKER = re.compile(r"(?:[-*•・‣]|\(?\d{1,3}[.)）、．]|[①-⑳])")
_ITEM = re.compile(rf"^\s*{_MARKER.pattern}\s*(.*)$")
_LISTING = re.compile(rf"[\r\n]|[:：]\s*$|^\s*{_MARKER.pattern}")
_MARK = re.compile("^|\r\n|[\r\n]|```|[*][*]|[\\\\\"<" + re.escape("".join(_PAIRS) + "".join(_PAIRS.values())) + "]")
_LINE = re.compile(r"[^\r\n]*")
_CITATION = re.compile(r"\s*(?:\[\d+\]|[(（\[][^()（）\[\]]{1,120}[)）\]])\s*$")
_STOPPED = re.compile(r"(?:…|\.\.\.|。。|\[\s*(?:\.\.\.|…)\s*\]|[,、，;；:：\-–—(（「\[{/&+])\s*$")
_TERMINATED = re.compile(r"[.。．!?！？।॥][\"'”’»」』）)\]*_\s]*$")
_ABBREVIATED = re.compile(r"\w\.\w\.\.$")
_SENTENCE = re.compile(r"[^。！？!?।\n]*?(?:[。！？!?।]+|\n+|\.(?=\s|$)|$)")
_SKELETON = re.compile(r"\d+(?:[.,]\d+)*|[ァ-ヺー]+|[぀-ゟ㐀-鿿々〇]|(?:[^\W\d_]|[̀-ͯऀ-ॣॱ-ॿ'’])+|[.。．!?！？।॥\n]|[,、，;；:：]|%|％|[^\s\w]")
_LATIN_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")


def bare(text: str) -> str:
    """text without invisible characters, tags, entities and emphasis marks, trimmed; a JSON object of one string gives the string."""
    text = visible(text)
    wrapped = _JSON.match(text)
    if wrapped:
        try:
            text = str(next(iter(json.loads(text, strict=False).values())))
        except ValueError:
            text = wrapped.group(2)
    else:
        text = _JSON_OPEN.sub("", text, count=1) if _JSON_OPEN.match(text) else text
    text = _ENTITY.sub(" ", _TAG.sub(" ", text)).replace("```", "").replace("**", "").replace("__", "")
    return text.strip()


def is_empty(text: str | None) -> bool:
    """Nothing but blanks, invisible characters, punctuation, markup, or a word that stands for no value."""
    if text is None:
        return True
    rest = bare(text)
    return not any(map(str.isalnum, rest)) or " ".join(rest.lower().strip(" .。-–—*\"'`()[]<>{}।").split()) in NO_VALUE


def _announced(head: str, listed: bool) -> int | None:
    """The number of items that a line announces in its last sentence. Without a colon it does so only before a list."""
    head = head.strip()
    if not head.endswith((":", "：") if not listed else (":", "：", "。", "।")):
        return None
    parts = [p for p in re.split(r"[。！？!?।]|\.\s", head) if p.strip(" :：")]
    if not parts:
        return None
    words = parts[-1].strip(" :：").split()
    for w, n in COUNT_WORDS.items():
        if w in words or (len(w) == 2 and w[1] in "つ点" and w in parts[-1]):
            return n
    digits = re.search(r"(\d)\s*(?:点|つ|punti|points|बिंदु|बातें)", parts[-1])
    return int(digits.group(1)) if digits else None


class _List:
    """A list on the parser's stack: how many items were announced and read, and whether the last one holds anything."""

    def __init__(self, announced: int | None) -> None:
        self.announced, self.items, self.filled = announced, 0, True

    def short(self) -> bool:
        return self.announced is not None and self.items < self.announced


class _Lines:
    """The part of the parser that reads line starts: pushes a list at its first marker, or at the line that announces it,
    and pops it at a plain line behind a blank one."""

    def __init__(self) -> None:
        self.open: _List | None = None
        self.head, self.lines, self.after_blank, self.stopped = "", 0, False, False

    def line(self, line: str) -> None:
        if not line.strip():
            self.after_blank = True
            return
        self.lines += 1
        item = _ITEM.match(line)
        if item and (self.open or self.lines > 1 or any(map(str.isalnum, item.group(1)))):
            self.open = self.open or _List(_announced(self.head, True))
            self.open.items += 1
            self.open.filled = bool(item.group(1).strip())
        elif self.open and not self.after_blank:
            self.open.filled = True  # an item goes on
        else:
            self.stopped |= self.open is not None and self.open.short()
            self.open, self.head = None, line
        self.after_blank = False

    def end(self) -> bool:
        """Whether a list is open: too few items, an empty last one, or none behind the line that announces them."""
        if self.open is None:
            return self.stopped or _announced(self.head, False) is not None
        return self.stopped or self.open.short() or (not self.open.filled and self.lines > 1)


def open_structures(text: str) -> list[str]:
    """What a pushdown parser of lists, fences, brackets, quotations, markup and JSON strings has on its stack at the end.

    Closers without an opener are ignored. Inside a fence only the fence's end counts. Straight quotes open only before a
    word and at a blank or bracket; apostrophes are no quotes. A list is open, as `list`, while it has fewer items than the
    line before it announces, or an empty last item.
    """
    stack: list[str] = []
    if not _OPENER.search(text) and not _LISTING.search(text):
        return stack
    lines, at = _Lines(), 0
    for mark in _MARK.finditer(text):
        k, c = mark.start(), mark.group()
        if k < at:
            continue  # inside a tag or behind an escape
        at = mark.end()
        fenced = bool(stack) and stack[-1] == "```"
        if not c or c[0] in "\r\n":
            if not fenced:
                following = _LINE.match(text, at).group()
                lines.line(following)
        elif c == "```":
            stack.pop() if fenced else stack.append("```")
        elif fenced:
            continue
        elif c == "**":
            after = text[k + 2 : k + 3]
            if "**" in stack:
                while stack.pop() != "**":
                    pass
            elif after and not after.isspace() and after != "*":
                stack.append("**")
        elif c == "<":
            tag = _TAG.match(text, k)
            if tag:
                name = "<" + tag.group(1).lower()
                if text[k + 1] == "/":
                    if name in stack:
                        while stack.pop() != name:
                            pass
                elif not tag.group(2) and name not in ("<br", "<hr", "<img", "<li", "<p", "<input"):
                    stack.append(name)
                at = tag.end()
        elif c == "\\":
            at = k + 2 if '"' in stack else at
        elif c == '"':
            before, after = text[k - 1 : k], text[k + 1 : k + 2]
            if '"' in stack:
                while stack.pop() != '"':
                    pass
            elif (not before or before.isspace() or before in "([{（「:,") and (not after or not after.isspace()):
                stack.append('"')
        elif c in _PAIRS:
            stack.append(c)
        elif c in _CLOSERS and _CLOSERS[c] in stack:
            while stack.pop() != _CLOSERS[c]:
                pass
    return [*stack, "list"] if lines.end() else stack


def list_incomplete(text: str) -> bool:
    """Whether a list stops early: a last marker without an item, a number announced and not reached, or none of it there."""
    return "list" in open_structures(text.rstrip())


def _automaton(words: list[str]) -> tuple[list[dict[str, int]], list[int], list[int], list[int]]:
    """The suffix automaton of a token list: transitions, links, lengths, and the end of a first occurrence of each state."""
    moves, links, lengths, ends, last = [{}], [-1], [0], [0], 0
    for k, w in enumerate(words):
        new = len(moves)
        moves.append({})
        links.append(0)
        lengths.append(k + 1)
        ends.append(k + 1)
        p = last
        while p >= 0 and w not in moves[p]:
            moves[p][w] = new
            p = links[p]
        if p >= 0:
            q = moves[p][w]
            if lengths[q] == lengths[p] + 1:
                links[new] = q
            else:
                clone = len(moves)
                moves.append(dict(moves[q]))
                links.append(links[q])
                lengths.append(lengths[p] + 1)
                ends.append(ends[q])
                links[q] = links[new] = clone
                while p >= 0 and moves[p].get(w) == q:
                    moves[p][w] = clone
                    p = links[p]
        last = new
    return moves, links, lengths, ends


def tiling(answer: list[str], question: list[str], least: int) -> tuple[list[bool], int]:
    """(tokens of the answer that lie in tiles, tokens of the question that tiles use) by greedy string tiling.

    Tiles are the longest common runs of at least `least` tokens, longest first, none over another in the answer. The
    question may stand in the answer several times. The runs come from one walk through the question's suffix automaton,
    so the work grows with the lengths, not with their product.
    """
    moves, links, lengths, ends = _automaton(question)
    runs, state, size = [], 0, 0
    for k, w in enumerate([*answer, None]):
        before = (size, ends[state], k)
        while state and w not in moves[state]:
            state = links[state]
            size = lengths[state]
        if w in moves[state]:
            state, size = moves[state][w], size + 1
        else:
            size = 0
        if size <= before[0] and before[0] >= least:  # the run that ended before this token could not go on
            runs.append(before)
    marked, used = [False] * len(answer), [False] * len(question)
    for size, q_end, a_end in sorted(runs, key=lambda r: (-r[0], r[2])):
        a, b = a_end - size, a_end
        while a < b and marked[a]:
            a += 1
        while a < b and marked[b - 1]:
            b -= 1
        if b - a >= least and not any(marked[a:b]):
            marked[a:b] = [True] * (b - a)
            start = q_end - size + (a - (a_end - size))
            used[start : start + b - a] = [True] * (b - a)
    return marked, sum(used)


def is_copied(text: str, question: str) -> bool:
    """Whether the text is the question, once or more, and nothing but labels besides."""
    rest = bare(text)
    a, q = tokens(rest), tokens(question)
    if not a or not q:
        return False
    vocabulary = set(q)
    if sum(w in vocabulary for w in a) < 0.5 * len(a):
        return False
    least = min(3 if any("぀" <= w[0] <= "鿿" for w in q) else 2, len(q))
    marked, used = tiling(a, q, least)
    if len(a) > len(q) and not marked[-1] and any(w.startswith(a[-1]) for w in vocabulary):
        marked[-1] = True  # the last of several copies stops inside a word
    spans: list[list[str]] = [[]]  # what is left between tiles
    for w, m in zip(a, marked, strict=True):
        if m and spans[-1]:
            spans.append([])
        elif not m and w not in LABELS:
            spans[-1].append(w)
    for span in spans:
        cjk = "".join(w for w in span if "぀" <= w[0] <= "鿿" and len(w) == 1)
        other = [w for w in span if not ("぀" <= w[0] <= "鿿" and len(w) == 1)]
        if any(w[0].isdigit() or w not in vocabulary for w in other) or len(JA_LABELS.sub("", cjk)) > 1 or len(cjk) > 12:
            return False
    return used >= 0.6 * len(q) and not rest.rstrip(" 。").endswith(("に", "につ", "について", "につい"))


def _sentences(text: str) -> list[str]:
    return [s.strip() for s in _SENTENCE.findall(text) if s.strip(" \t\r\n\"'.。-*「」")]


def is_refusal(text: str) -> bool:
    """Whether the text declines to answer in the first person and answers nothing: every sentence declines, regrets or offers help."""
    rest = bare(text)
    if not _DECLINE.search(rest):
        return False
    return all(_CLAUSE.search(p) for p in _sentences(rest.replace("S.r.l.", "Srl").replace("S.p.A.", "SpA")))


def says_missing(text: str) -> bool:
    """Whether every sentence of the text states that the information is missing; a missing detail beside an answer is none."""
    parts = _sentences(bare(text))
    return bool(parts) and all(_MISSING.match(p) for p in parts)


def language_of(text: str) -> str | None:
    """Language of a text's sentences: by script, within a script by function words; None where they don't tell.

    Citations in brackets and quoted names count for nothing.
    """
    plain = re.sub(r"[(（\[][^()（）\[\]]*[)）\]]", " ", text)
    latin = kana = han = deva = 0
    for c in plain:
        o = ord(c)
        if o < 0x250:
            latin += c.isalpha()
        elif 0x3041 <= o <= 0x3096:
            kana += 1
        elif 0x4E00 <= o <= 0x9FFF:
            han += 1
        elif 0x900 <= o <= 0x97F:
            deva += 1
    total = latin + kana + han + deva
    if not total:
        return None
    if (kana + han) * 2 > total:
        if kana:
            return "ja"
        return "zh" if han >= 8 and (han >= 12 or re.search(r"[了这该并们为说么还让给从对应东车亏损万红迟长个时说]", plain)) else None
    words = re.findall(r"[^\W\d_]+(?:['’](?=\w))?|[ऀ-ॣॱ-ॿ]+", re.sub(r"[ऀ-ॿ]+", lambda m: f" {m.group()} ", plain).lower())
    if deva * 2 > total:
        words = re.findall(r"[ऀ-ॣॱ-ॿ]+", plain)
        best = max(("hi", "mr", "ne"), key=lambda x: (sum(w in FUNCTION_WORDS[x] for w in words), x == "hi"))
        return best if len(words) >= 3 else None
    if latin * 2 > total:
        scores = {x: sum(w in FUNCTION_WORDS[x] for w in words) for x in ("it", "en", "es", "fr", "de", "pt")}
        best = max(scores, key=lambda x: (scores[x], x == "it"))
        return best if scores[best] >= 2 and len(words) >= 4 else "latin" if len(words) >= 5 else None
    return None


def is_wrong_language(text: str, question: str) -> bool:
    """Whether the sentences of the text are in another language than the question."""
    rest = bare(text)
    asked, given = language_of(question), language_of(rest)
    if asked is None or given is None or given == asked:
        return False
    script = {"ja": "cjk", "zh": "han", "hi": "deva", "mr": "deva", "ne": "deva"}
    if given == "latin" or asked == "latin":
        return script.get(given, "latin") != script.get(asked, "latin")
    if script.get(given, "latin") == script.get(asked, "latin") == "latin":
        words = re.findall(r"[^\W\d_]+", rest.lower())
        return sum(w in FUNCTION_WORDS[given] for w in words) >= 1.5 * sum(w in FUNCTION_WORDS[asked] for w in words) + 1
    return True


def _strip_citations(text: str) -> str:
    while True:
        cut_text = _CITATION.sub("", text)
        if cut_text == text or not cut_text.strip():
            return text
        text = cut_text


def skeleton(text: str) -> list[str]:
    """Tokens with `9` for numbers and `N` for names (capitalised words inside a sentence, katakana runs), one for a run of names; `.` ends a sentence."""
    out: list[str] = []
    for w in _SKELETON.findall(text):
        if w[0].isdigit():
            w = "9"
        elif "゠" <= w[0] <= "ヿ" or (_LATIN_UPPER.match(w) and out and out[-1] != "."):
            w = "N"
        elif w in ".。．!?！？।॥\n":
            if w == "." and out and (len(out[-1]) == 1 and out[-1] != "9" and out[-1].isalpha() and out[-1].isascii()):
                continue  # part of an abbreviation
            w = "."
        else:
            w = w.lower()
        if not (w == out[-1] if w in "N." and out else False):
            out.append(w)
    return out


CONTEXTS = (8, 5, 3, 2, 1)
#: Level of the last word as the beginning of longer words, behind the levels of CONTEXTS.
PREFIX_LEVEL = len(CONTEXTS)


def _hash(context: list[str]) -> int:
    return xxhash.xxh3_64_intdigest("\x1f".join(context)) >> 1


def tail_contexts(text: str) -> list[int] | None:
    """Hashes of the last 8, 5, 3, 2 and 1 tokens of the text's last sentence (`^` before its first token), then of its last
    word as a beginning; None if it has none."""
    tokens_of = skeleton(text)
    while tokens_of and tokens_of[-1] == ".":
        tokens_of.pop()
    start = max((k + 1 for k, w in enumerate(tokens_of) if w == "."), default=0)
    sentence = ["^", *tokens_of[start:]]
    return [*(_hash(sentence[-k:]) for k in CONTEXTS), _hash(["<", sentence[-1]])] if len(sentence) > 1 else None


def _last_word(text: str) -> str:
    """The last run of letters and their marks."""
    def letter(c: str) -> bool:
        return c.isalpha() or unicodedata.category(c)[0] == "M"

    b = len(text)
    while b and not letter(text[b - 1]):
        b -= 1
    a = b
    while a and letter(text[a - 1]):
        a -= 1
    return text[a:b]


_ECHO_END = re.compile(r"[\s。？?！!.]*[」』\"”'’»*]*(?:について|に関して|に対して)?[、,:：。\s]*")


def answer_part(text: str, question: str) -> str:
    """The text without the question it opens with, if something is left."""
    rest, asked = bare(text), bare(question).rstrip(" 。？?！!.")
    at = rest.find(asked, 0, len(asked) + 4) if asked else -1
    left = rest[_ECHO_END.match(rest, at + len(asked)).end() :] if at >= 0 else ""
    return left or rest


def structure_defect(text: str | None, question: str, kind: str | None) -> str | None:
    """The defect that the field alone shows: empty, copied, refusal, wrong_language or truncated."""
    unanswerable = kind == "unanswerable"
    if is_empty(text):
        return None if unanswerable else "empty"
    if is_copied(text, question):
        return "copied"
    if is_refusal(text):
        return "refusal"
    if says_missing(text):
        return None if unanswerable else "refusal"
    if is_wrong_language(text, question):
        return "wrong_language"
    plain = visible(text)
    if open_structures(plain.rstrip()) or (_JSON.match(plain) and open_structures(bare(plain))):
        return "truncated"
    rest = bare(text)
    tail = _strip_citations(rest).rstrip()
    if _STOPPED.search(rest) or (_STOPPED.search(tail) and tail != rest) or (re.search(r"[^.]\.\.$", rest) and not _ABBREVIATED.search(rest)):
        return "truncated"
    last = _last_word(tail)
    if last and not tail.endswith(("%", "％")) and not tail[-1].isdigit():
        # behind a full stop, Hindi postpositions may be verbs (की)
        stopped_on = last.lower() in NEVER_LAST and (last.isascii() or not _TERMINATED.search(tail))
        if stopped_on and tail.rstrip(" .।。").endswith(last):
            return "truncated"
        if not _TERMINATED.search(tail) and tail.endswith(NEVER_LAST_JA):
            return "truncated"
    return None


def needs_statistics(text: str) -> str | None:
    """The text whose end counts, if it stops without a mark; None if it ends with one."""
    tail = _strip_citations(bare(text)).rstrip(" \t\r\n\"'”’»」』*_")
    return None if not tail or _TERMINATED.search(tail) else tail


#: Share of a context's occurrences that must end a sentence or text, and occurrences a context needs to count.
END_SHARE, CONTEXT_ROWS = 0.12, 4
#: Longer words with the same beginning, for each time the last word stands elsewhere, that show a cut inside a word.
LONGER_WORDS = 10
#: Ends with the same hash from which they are joined apart from the rest, by broadcast of their counts.
HOT = 50_000


def pair_defects(df: DataFrame, key: str, question: str, fields: list[str], kind: str, at: str, learn: list[str] | None = None) -> DataFrame:
    """(key, field_name, defect): one row per key and defective field.

    fields: the answer columns. kind: the column of the question type; with `unanswerable`, an empty field and a statement
    that the information is missing are right. at: of several rows with one key the latest counts (a null time is the
    oldest). learn: further columns (text, or arrays of text) whose sentences show how sentences end. Rows with a null key
    are left out, a null question is an empty one; an empty table gives an empty result; other columns are ignored.
    A text that ends without a mark is truncated if, of all places where its last words stand, few end a sentence (equal
    texts count once); the longest context with CONTEXT_ROWS further occurrences decides, and one that occurs nowhere else
    is truncated unless it is a short phrase, be it behind the repeated question.
    """
    learn = learn or []
    columns = {c: F.col(c) if df.schema[c].dataType == T.StringType() else F.array_join(c, "\n") for c in [*fields, *learn]}
    packed = df.select(F.col(key).alias("k"), F.struct(F.col(at).alias("at"), F.coalesce(question, F.lit("")).alias("q"), F.col(kind).alias("t"), F.array(*(columns[c] for c in fields)).alias("x"), F.array(*(columns[c] for c in learn)).cast("array<string>").alias("l")).alias("r")).dropna(subset=["k"])
    rows = cut(packed.groupBy("k").agg(F.max("r").alias("r")).select("k", "r.q", "r.t", "r.x", "r.l"))
    type_of = rows.schema["k"].dataType.simpleString()

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for k, q, t, texts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for name, text in zip(fields, texts, strict=True):
                    defect = structure_defect(text, q, t)
                    if defect:
                        out.append((k, name, defect, None, False))
                        continue
                    if text is None or is_empty(text) or needs_statistics(text) is None or says_missing(text):
                        continue
                    part = answer_part(text, q)
                    tail = needs_statistics(part)
                    contexts = tail_contexts(tail) if tail else None
                    if contexts:
                        words = skeleton(tail)
                        short = len(words) <= 6 or (len(words) <= 10 and "぀" <= tail[-1] <= "鿿")
                        out.append((k, name, None, contexts, short and len(words) == len(skeleton(part))))
            columns_out = list(zip(*out, strict=True)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(columns_out[0], batch.schema.field(0).type), pa.array(columns_out[1], pa.string()), pa.array(columns_out[2], pa.string()), pa.array(columns_out[3], pa.list_(pa.int64())), pa.array(columns_out[4], pa.bool_())], names=["k", "field_name", "defect", "contexts", "short"])

    judged = cut(rows.select("k", "q", "t", "x").mapInArrow(judge, f"k {type_of}, field_name string, defect string, contexts array<long>, short boolean"))
    tails = judged.filter("defect is null").select("k", "field_name", "short", F.posexplode("contexts").alias("level", "h"))
    sent = df.sparkSession.sparkContext.broadcast(hash_filter(tails))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        want, beginnings, last_words = sent.value, {}, {}
        for batch in batches:
            ends: Counter[int] = Counter()
            mids: Counter[int] = Counter()
            for text in batch.column(0).to_pylist():
                _count_contexts(text, want, ends, mids, beginnings, last_words)
            hashes = list({*ends, *mids})
            yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.int64()), pa.array([ends[h] for h in hashes], pa.int64()), pa.array([mids[h] for h in hashes], pa.int64())], names=["h", "ends", "mids"])

    # a text that stands under several keys or in several fields shows once how its sentences end
    different = rows.select(F.explode(F.concat("x", "l")).alias("text")).filter("text <> ''").distinct()
    wanted = tails.groupBy("h").agg(F.count(F.lit(1)).alias("tails"))
    counts = cut(different.mapInArrow(count, "h long, ends long, mids long").groupBy("h").agg(F.sum("ends").alias("ends"), F.sum("mids").alias("mids")).join(wanted, "h"))
    hot = counts.filter(F.col("tails") > HOT).drop("tails")
    if counts.filter(F.col("tails") > HOT).limit(1).count():
        hot = small(hot)
        cold = tails.join(hot, "h", "left_anti").join(counts.filter(F.col("tails") <= HOT).drop("tails"), "h", "left")
        known = cold.unionByName(tails.join(hot, "h"))
    else:
        known = tails.join(small(counts.drop("tails")), "h", "left")
    known = known.withColumns({"ends": F.coalesce("ends", F.lit(0)) - 1, "mids": F.coalesce("mids", F.lit(0))})
    seen = (F.col("ends") + F.col("mids") >= CONTEXT_ROWS) & (F.col("level") < PREFIX_LEVEL)
    best = known.groupBy("k", "field_name").agg(
        F.min_by(F.struct("ends", "mids"), F.when(seen, F.col("level"))).alias("c"), F.first("short").alias("short"), F.max(F.when(F.col("level") == PREFIX_LEVEL - 1, F.col("ends") + F.col("mids"))).alias("last"), F.max(F.when(F.col("level") == PREFIX_LEVEL, F.col("mids"))).alias("longer")
    )
    inside_word = F.col("longer") > LONGER_WORDS * F.col("last")
    rarely_last = F.col("c.ends") < END_SHARE * (F.col("c.ends") + F.col("c.mids"))
    open_end = inside_word | F.when(F.col("c").isNull(), ~F.col("short")).otherwise(rarely_last | (F.col("last") < 1))
    stopped = best.filter(open_end).select("k", "field_name", F.lit("truncated").alias("defect"))
    return judged.filter("defect is not null").select("k", "field_name", "defect").unionByName(stopped).withColumnRenamed("k", key)


def _count_contexts(text: str, want: HashFilter, ends: Counter[int], mids: Counter[int], beginnings: dict[str, list[int]], last_words: dict[str, bool]) -> None:
    """Adds, for every context of `want` in the text, whether a sentence or the text ends behind it, and every
    beginning of a word. beginnings, last_words: what is known of words so far."""
    if len(last_words) > 100_000:
        last_words.clear()
    words = skeleton(_strip_citations(bare(text)))
    start = 0
    for w in words:
        if len(w) > 1:
            if w not in beginnings:
                if len(beginnings) > 100_000:
                    beginnings.clear()
                beginnings[w] = [h for h in (_hash(["<", w[:k]]) for k in range(1, len(w))) if h in want]
            for h in beginnings[w]:
                mids[h] += 1
    for k in range(len(words)):
        if words[k] == ".":
            start = k + 1
            continue
        # every wanted context ends on a wanted last word
        if words[k] not in last_words:
            last_words[words[k]] = _hash([words[k]]) in want
        if not last_words[words[k]]:
            continue
        sentence = ["^", *words[start : k + 1]] if k - start < CONTEXTS[0] else words[k + 1 - CONTEXTS[0] : k + 1]
        last = k + 1 == len(words) or words[k + 1] == "."
        done = 0
        for size in CONTEXTS:
            part = sentence[-size:]
            if len(part) == done:
                continue  # a short sentence has one context for the longer sizes
            done = len(part)
            h = _hash(part)
            if h in want:
                (ends if last else mids)[h] += 1

