"""Defects of instruction-response pairs: empty, refusal, copy, truncated, language.

A response is compressed with its own prompt as a zstandard dictionary. What is left is what the response adds; of the
few responses that add next to nothing, a comparison word by word tells copies from answers that quote and go on.
Dictionaries of refusals and of the languages' scripts and commonest words give two other labels.

Whether a response breaks off is told by the context of its end: open code, a mark without its item, a heading without
its text, and a model of ends that is learnt from the whole column. The model holds how often finished lines of each kind
end with a mark, which tokens end finished lines, and which tokens with a point are followed by small letters, so that a
point behind them ends nothing.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher
from functools import lru_cache

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adit.runtime import cut

#: What stands for no answer, in small letters without brackets.
PLACEHOLDERS = frozenset(
    (
        "-", "--", "---", ".", "..", "...", "…", "?", "n/a", "na", "n.a.", "none", "null", "nil", "nan", "tbd", "tba", "todo", "empty", "blank", "output", "response", "answer", "placeholder",
        "undefined", "no answer", "no output", "no response", "not available", "not applicable", "to be done", "your answer here", "insert answer here", "lorem ipsum",
    )
)
#: How answers are declined. Who speaks, what they don't do, and what an assistant could have done.
_ASSISTANT = r"(?:this|the|your) (?:ai |virtual )?(?:assistant|model|bot|chatbot)"
_CANT = r"(?:can['’]?t|cannot|can not|won['’]t|will not|may not|(?:am|is|are) (?:unable|not able|not allowed|not permitted) to|(?:must|ha(?:ve|s) to) (?:refuse|decline)|refuses? to|declines? to|do(?:es)? not feel comfortable|do(?:es)?n['’]t feel comfortable)"
_SERVE = r"(?:help|assist|answer|provide|discuss|comply|fulfil|respond|reply|support|engage|comment|process)"
REFUSALS = regex.compile(
    r"\bi(?: am|['’]m)? (?:very |really |truly )?(?:sorry|afraid)\b[^.!?\n]{0,60}\b(?:can['’]?t|cannot|can not|unable|not able|won['’]t|must)"
    rf"|\bi {_CANT}\b(?! (?:overstate|stress|emphasi[sz]e|rule out|confirm))"
    rf"|\b(?:we|{_ASSISTANT}) {_CANT} {_SERVE}"
    r"|\bi['’]m (?:unable|not able|not allowed|not permitted)\b"
    rf"|\bnot (?:a|the|an?) (?:kind of )?(?:request|question|topic|task|subject|thing) (?:that |which )?(?:i|we|{_ASSISTANT}) (?:can|could|will|would|may|am|is|are)\b"
    r"|\bmy (?:policies|policy|guidelines|principles|rules) (?:do|does|don['’]t|doesn['’]t) (?:not )?(?:allow|permit)"
    r"|\bagainst my (?:guidelines|policies|policy|principles|rules)"
    r"|\boutside (?:of )?what i (?:may|can|am)|\boff[ -]limits for me|\bnot be appropriate for me|\bsomething (?:that )?i (?:have to|must) (?:decline|refuse)"
    r"|\bno (?:answer|response|reply|help|assistance) (?:can|may|will) be (?:given|provided|offered)|\bcan(?:no|['’])t be (?:discussed|answered) here"
    r"|\bas an? (?:ai|assistant|language model)\b[^.!?\n]{0,40}\b(?:can['’]?t|cannot|unable|not able)"
    r"|\b(?:désolée?|regrette)\b[^.!?\n]{0,40}\bne (?:peux|puis) pas|\bje ne (?:peux|puis) pas (?:vous )?(?:répondre|aider|traiter)|\bje (?:dois|suis obligée?) (?:de )?(?:refuser|décliner)"
    r"|\b(?:tut mir leid|leider|bedauere?)\b[^.!?\n]{0,60}\bnicht|\bdabei kann ich (?:ihnen |dir )?nicht helfen|\bich (?:muss|möchte) (?:das )?ablehnen"
    r"|\b(?:lo siento|lamento)\b[^.!?\n]{0,40}\bno puedo|\bno puedo (?:ayudar|responder|atender)"
    r"|(?:к сожалению|извините|простите)[^.!?\n]{0,40}не (?:могу|в состоянии)|\bя не могу (?:помочь|ответить)|\bвынужден[а]? отказать"
    r"|申し訳(?:ありません|ございません)[^。\n]{0,40}(?:できません|いたしかねます)|(?:お答え|お手伝い)(?:は)?できません|(?:抱歉|对不起|對不起)[^。\n]{0,20}(?:无法|無法|不能)|我(?:无法|無法|不能)(?:回答|提供|协助|協助|帮助|幫助)"
    r"|죄송(?:합니다|하지만)[^.\n]{0,40}(?:없습니다|수 없)",
    regex.I,
)
#: Parts of words, in small letters, of which every refusal has one: a text that has none isn't searched.
_DECLINES = (
    "sorry", "afraid", "can't", "can’t", "cant", "cannot", "can not", "won't", "won’t", "will not", "may not", "unable", "not able", "not allowed", "not permitted", "refuse", "decline", "comfortable",
    "not a", "not the", "polic", "guidelines", "principles", "rules", "outside", "off limits", "off-limits", "appropriate for me", "be given", "be provided", "be offered", "be discussed", "be answered",
    "désol", "regrett", "peux pas", "puis pas", "refuser", "décliner", "leid", "bedauer", "nicht helfen", "ablehnen", "siento", "lamento", "no puedo", "сожал", "извин", "прост", "не могу", "отказ",
    "申し訳", "できません", "抱歉", "对不起", "對不起", "无法", "無法", "不能", "죄송",
)

#: Names of languages, by beginning, and commonest words of the languages that others don't have.
NAMED = {
    "en": ("english", "englisch", "anglais", "inglés", "английск"),
    "de": ("german", "deutsch", "allemand", "alemán", "немецк"),
    "fr": ("french", "französisch", "français", "francés", "французск"),
    "es": ("spanish", "spanisch", "espagnol", "español", "castellano", "испанск"),
    "ru": ("russian", "russisch", "russe", "ruso", "русск"),
    "it": ("italian", "italienisch", "italien", "italiano", "итальянск"),
    "pt": ("portuguese", "portugiesisch", "portugais", "portugués", "português", "португальск"),
    "nl": ("dutch", "niederländisch", "néerlandais", "neerlandés", "nederlands", "нидерландск"),
    "pl": ("polish", "polnisch", "polonais", "polaco", "polsk", "польск"),
    "uk": ("ukrainian", "ukrainisch", "ukrainien", "ucraniano", "українськ", "украинск"),
    "ja": ("japanese", "japanisch", "japonais", "japonés", "японск", "日本語"),
    "zh": ("chinese", "chinesisch", "chinois", "chino", "китайск", "中文", "汉语"),
    "ko": ("korean", "koreanisch", "coréen", "coreano", "корейск", "한국어"),
    "ar": ("arabic", "arabisch", "arabe", "árabe", "арабск", "العربية"),
    "el": ("modern greek", "in greek", "griechisch", "en grec", "en griego", "на греческ", "ελληνικά"),
    "he": ("hebrew", "hebräisch", "hébreu", "hebreo", "иврит", "עברית"),
    "hi": ("hindi", "хинди", "हिन्दी"),
    "th": ("in thai", "thailändisch", "thaïlandais", "tailandés", "на тайск", "ภาษาไทย"),
}
WORDS = {
    "en": "the of and to is that it was for with are be this on by not which as from they those can may what how why who should these than has have its an or at were been will would there their you your",
    "de": "der die das und ist nicht mit von den dem des ein eine einen einer zu auf für sich im wird werden oder aus durch wenn sie es wie was nur noch auch bei nach dass kann ich wir ihr zum zur als vor über am sofern während",
    "fr": "la le suivant suivante les des est une dans pour qui pas du au aux avec sur par ce cette ces sont ne et il elle vous nous je peut faut quoi comment pourquoi plus sans ou où d l en un à après avant lorsque",
    "es": "la el siguiente siguientes los las una que por con se es para del al lo como más su sus este esta hay cuando cómo qué y si ya sin sobre también pero unos muy todos todas en tras puede",
    "it": "il gli che non della delle dei nel nella sono è questo questa di più anche quando dal dalla viene essere dopo prima perché",
    "pt": "não uma dos são pelo pela ao foi também isso você seu sua às quando depois antes então",
    "nl": "het een van niet dat zijn voor op aan wordt deze door ook bij naar omdat maar wanneer",
    "pl": "nie jest się na że przez są oraz dla jak po od który która które tylko może gdy przed aby",
}
_LANGUAGE_OF = {lang: frozenset(words.split()) for lang, words in WORDS.items()}
_LETTERS = {"de": "ßäöü", "fr": "èêçàœëîôûâù", "es": "ñ¿¡áíóú", "pt": "ãõ", "pl": "ąćęłńśźż"}
#: Scripts with the language that they tell, the more particular one first.
SCRIPTS = {
    "ja": r"\p{Hiragana}\p{Katakana}", "ko": r"\p{Hangul}", "zh": r"\p{Han}", "uk": "іїєґІЇЄҐ", "ru": r"\p{Cyrillic}", "el": r"\p{Greek}", "ar": r"\p{Arabic}", "he": r"\p{Hebrew}",
    "hi": r"\p{Devanagari}", "th": r"\p{Thai}",
}

_INVISIBLE = re.compile("[\u200b-\u200f\u2060-\u2064\ufeff\u00ad]")
_HEADING = re.compile(r"^[ \t]*(?:#{1,6}[ \t].*|\*\*[^*\n]+\*\*:?|__[^_\n]+__:?)[ \t]*$", re.M)
_MARKUP = re.compile(r"<[^<>\n]{0,80}>|^[ \t]*(?:`{3,}.*|~{3,}.*|[-*+•][ \t]*|\d+[.)][ \t]*|>|\|[-| :]*\||={3,}|-{3,}|\*{3,})[ \t]*$", re.M)
_LABEL = re.compile(r"^\s*(?:q|question|you asked|prompt|instruction|input|task|user|frage|pregunta|вопрос|a|answer|output)\s*[:.]\s*", re.I)
_FENCE = re.compile(r"^[ \t]*(?:```|~~~)", re.M)
_ITEM = re.compile(r"^[ \t]*(?:[-*+•]|\d+[.)])[ \t]+\S")
_ENDED = re.compile(r"[.!?…。！？][\"'”’»)\]*_]*$")
_IDENTIFIERS = regex.compile(r"(?:^|[\s,;(])(?:[A-Z]{2,8}-\d+(?:-\d+)?|T\d{4}(?:\.\d{3})?)(?:[,;\s]+(?:[A-Z]{2,8}-\d+(?:-\d+)?|T\d{4}(?:\.\d{3})?))*$")
_LINK = re.compile(r"\bhttps?://[\w.-]+\.\w{2,}(?:/\S*)?$")
_BARE_MARK = re.compile(r"[-*+•>#]+|\d+[.)]")
_BREAKS = re.compile("[\r\v\f\x1c-\x1e\x85\u2028\u2029]")
_NOT_WORD = re.compile(r"[^\w\s]+")
_WORD = re.compile(r"[^\W\d_]+")
_IN_SCRIPT = {lang: regex.compile(f"[{letters}]") for lang, letters in SCRIPTS.items()}
_OTHER_SCRIPT = regex.compile("[" + "".join(SCRIPTS.values()) + "]")
#: Where letters of other scripts than Latin lie, for a quick look.
_BEYOND_LATIN = re.compile("[\u0370-\u1dff\u1f00-\u1fff\u2de0-\u2dff\u2e80-\ua63f\ua640-\ua69f\uac00-\ud7ff\uf900-\ufaff\U00020000-\U0003ffff]")
_ASCII_WORDS = str.maketrans({chr(c): " " for c in range(128) if not (chr(c).isalnum() or chr(c) == "_")})
_STOP = re.compile(r"[.!?\n]")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
_LABELS = regex.compile(r"^(?:[^\n:]{1,30}: [^\n]*\n)*[^\n:]{1,30}: ")
_CODE = re.compile(r"```.*?(?:```|\Z)|https?://\S+|`[^`\n]*`", re.S)
_ID = re.compile(r"\b[A-Z]{2,}-[\d-]+\b")
_NAMES = {lang: regex.compile(r"\b(?:" + "|".join(names) + ")") for lang, names in NAMED.items()}
_IS = {w: tuple(lang for lang, known in _LANGUAGE_OF.items() if w in known) for known in _LANGUAGE_OF.values() for w in known}
_MARKS = {c: lang for lang, marks in _LETTERS.items() for c in marks}
_MARKED = re.compile("[" + "".join(_MARKS) + "]")
#: A token of few letters and points, and the letter behind it.
_SHORT = re.compile(r"(?<![^\s(])((?:[^\W\d_]{1,4}\.){1,4})\s+([^\W\d_])")


def _plain(text: str | None) -> str:
    """Small letters and digits, without marks, invisible characters and widths."""
    if not text:
        return ""
    if text.isascii():
        return " ".join(text.lower().translate(_ASCII_WORDS).split())
    return " ".join(_NOT_WORD.sub(" ", unicodedata.normalize("NFKC", _INVISIBLE.sub("", text)).casefold()).split())


def is_empty(output: str | None) -> bool:
    """Null, blank, or nothing but placeholders, headings and empty markup."""
    if output is None:
        return True
    # A long line that begins with a letter or digit and has no markup is more than a placeholder.
    if any(len(p) > 40 and p[0].isalnum() and "<" not in p for p in output.splitlines()):
        return False
    text = _MARKUP.sub("", _HEADING.sub("", _INVISIBLE.sub("", output)))
    parts = [p.strip() for p in text.splitlines()]
    return all(not p or p.casefold().strip("[](){}<>*_\"'` ") in PLACEHOLDERS or not p.strip("[](){}<>*_\"'` -.") for p in parts)


#: The same as one pattern, for whole columns.
_MAY_DECLINE = "|".join(re.escape(x) for x in _DECLINES)


def is_refusal(output: str) -> bool:
    """Whether any sentence, wherever it stands and however long the text is, declines to answer."""
    low = output.lower()
    for part in _DECLINES:
        at = low.find(part)
        while at >= 0:
            # No refusal reaches beyond a sentence.
            stop = _STOP.search(low, at)
            end = stop.start() if stop else len(low)
            if REFUSALS.search(low, max(low.rfind(c, 0, at) for c in ".!?\n") + 1, end):
                return True
            at = low.find(part, end)
    return False


def added(output: str, prompt: str) -> float:
    """The bytes to which output is compressed with prompt as its dictionary, over its bytes."""
    raw, known = output.encode(), prompt.encode()
    if not raw:
        return 0.0
    if len(known) < 8:
        return 1.0
    packer = zstandard.ZstdCompressor(
        level=9, dict_data=zstandard.ZstdCompressionDict(known, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False
    )
    return max(0, len(packer.compress(raw)) - 8) / len(raw)


#: A copy adds at most so much of its length; short texts have a larger share of overhead.
ADDED_LONG, ADDED_SHORT, SHORT = 0.22, 0.62, 100
#: A copy is at most so many times as long as what it copies, or as short.
LONGER = 1.6
#: Share of words that a copy has in common, in order, with what it copies.
ALIKE_LONG, ALIKE_SHORT = 0.85, 0.75


def is_copy(output: str, instruction: str | None, prompt: str | None) -> bool:
    """Whether output gives back the instruction, the input or both, at most trivially changed."""
    head = _HEADING.match(output.lstrip())
    if head and _plain(head[0]) not in _plain(prompt):
        return False  # it has the frame of an answer
    out = _plain(_LABEL.sub("", output))
    told, given = _plain(instruction), _plain(prompt)
    if not out:
        return False
    words, both = out.split(), f"{told} {given}"
    # What is much longer than all it could give back is no copy; most of the rest adds too much.
    if len(words) > 2 and len(words) >= LONGER * len(both.split()) or added(out, both) > (ADDED_SHORT if len(out) < SHORT else ADDED_LONG):
        return False
    # An input that opens with labelled lines may be given back without them.
    body = _plain((prompt or "").rsplit(": ", 1)[-1]) if "\n" in (prompt or "") else ""
    text_only = _plain(_LABELS.sub("", prompt or ""))
    for source in {told, given, both, f"{given} {told}", body, text_only}:
        want = source.split()
        if len(want) < 3:
            if words == want and words:
                return True
        elif 1 / LONGER < len(words) / len(want) < LONGER and SequenceMatcher(None, words, want, autojunk=False).ratio() >= (ALIKE_SHORT if len(want) <= 12 else ALIKE_LONG):
            return True
    return False


@dataclass(frozen=True)
class Ends:
    """What the column tells of ends.

    abbreviations: tokens with a point that don't end a sentence. marked: by kind of line ('item' or 'prose'), the share
    of finished lines that end with a mark. closing: words that end finished lines without one.
    """

    abbreviations: frozenset[str] = frozenset()
    marked: tuple[tuple[str, float], ...] = ()
    closing: frozenset[str] = frozenset()


def is_truncated(output: str, ends: Ends, prompt: str | None = None) -> bool:
    text = (output if output.isascii() else _INVISIBLE.sub("", output)).rstrip()
    fences = len(_FENCE.findall(text)) if "```" in text or "~~~" in text else 0
    if fences % 2:
        return True
    end = text[text.rfind("\n") + 1 :]
    if _BREAKS.search(end):
        end = end.splitlines()[-1]
    last = end.strip()
    if not last:
        return True
    if fences and _FENCE.match(end):
        return False
    if last.count("**") % 2 or last.count("`") % 2 or _BARE_MARK.fullmatch(last) or (last[0] in "#*_" and _HEADING.fullmatch(end)):
        return True
    if "://" in last and _LINK.search(last):
        return False
    if m := _IDENTIFIERS.search(last):
        numbers = [len(x) for x in re.findall(r"[A-Z]+-(\d+)(?!\S*-)", m[0])]
        return len(numbers) > 1 and numbers[-1] < min(numbers[:-1])
    if _ENDED.search(last):
        token = last.split()[-1].lstrip("([\"'«“")
        return token in ends.abbreviations or bool(re.search(r"(?:\.\.\.|…)$", last))
    if last[-1] in ",;:-–—(":
        return True
    # Without a mark: finished if lines of this kind end so, in this text or else in the column, with a whole word.
    lines, item = text.splitlines(), bool(_ITEM.match(end))
    others = [x.strip() for x in lines[:-1] if x.strip() and bool(_ITEM.match(x)) == item and not _HEADING.fullmatch(x)]
    if len(others) > 1 and item:
        bare = not any(_ENDED.search(x) for x in others)
    else:
        bare = dict(ends.marked).get("item" if item else "prose", 1.0) < 0.5
    return not bare or _is_cut(last, text, prompt, ends)


def _is_cut(last: str, text: str, prompt: str | None, ends: Ends) -> bool:
    """Whether the last word is met nowhere else, but as the beginning of other words."""
    words = _WORD.findall(last)
    if not words or not last.endswith(words[-1]):
        return False
    w = words[-1].lower()
    known = {x.lower() for x in _WORD.findall(f"{text[: -len(words[-1])]} {prompt or ''}")} | ends.closing
    return w not in known and any(x.startswith(w) for x in known)


def language(text: str | None) -> str | None:
    """The language that text is written in, by script and commonest words; None if there is too little of it."""
    if not text:
        return None
    low = text.lower()
    words = _WORD.findall(low)
    if not low.isascii():
        foreign = len(_OTHER_SCRIPT.findall(low)) if _BEYOND_LATIN.search(low) else 0
        if foreign and foreign > 0.4 * sum(map(len, words)):
            counts = {lang: len(p.findall(low)) for lang, p in _IN_SCRIPT.items()}
            # Japanese and Ukrainian share most letters with another language; their own letters tell them.
            if counts["ja"] * 10 > counts["zh"]:
                counts["zh"] = 0
            counts["ja"] *= 20
            counts["uk"] *= 30
            return max(counts, key=counts.get)
    score = dict.fromkeys(_LANGUAGE_OF, 0.0)
    for known, n in Counter(map(_IS.get, words)).items():
        for lang in known or ():
            score[lang] += n
    if not low.isascii():
        for c in _MARKED.findall(low):
            score[_MARKS[c]] += 0.5
    (best, most), (_, second) = sorted(score.items(), key=lambda x: -x[1])[:2]
    return best if most >= 1 and most > 1.3 * second else None


@lru_cache(4096)
def asked(instruction: str | None) -> str | None:
    """The language that an instruction names, the last one if several, else its own."""
    low = (instruction or "").lower()
    named = [(m.start(), lang) for lang, names in _NAMES.items() for m in names.finditer(low)]
    return max(named)[1] if named else language(instruction)


def answered(output: str, prompt: str | None) -> str | None:
    """The language of what an output says itself: without code, links, headings and what it quotes from the prompt."""
    text = _CODE.sub(" ", output) if "`" in output or "://" in output else output
    text = _HEADING.sub(" ", text) if "#" in text or "*" in text or "__" in text else text
    given, known, own = prompt or "", None, []
    low = given.lower()
    for p in _SENTENCE.split(text):
        if len(p) > 20 and given:
            if p.strip() in given:
                continue
            # What is quoted has all its words in the prompt; the last one tells most that aren't.
            end = p.rstrip(" \t.,;:!?").rsplit(None, 1)[-1:]
            end = end[0].lower() if end else ""
            if not end.isascii() or not end.isalnum() or end in low:
                known = _plain(prompt) if known is None else known
                if _plain(p) in known:
                    continue
        own.append(p)
    # Names of products and identifiers tell nothing.
    return language(_ID.sub(" ", " ".join(own)))


def defect(instruction: str | None, prompt: str | None, output: str | None, ends: Ends, may_decline: bool = True) -> str | None:
    """The one defect of a row, in the order of the tests; may_decline: False where no part of a refusal was found."""
    if is_empty(output):
        return "empty"
    if may_decline and is_refusal(output):
        return "refusal"
    if is_copy(output, instruction, prompt):
        return "copy"
    if is_truncated(output, ends, prompt):
        return "truncated"
    want = asked(instruction)
    got = want and answered(output, prompt)
    return "language" if got and want != got else None


def _count_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a batch: kind, token, n and k. Kinds: 'rows'; 'short' (tokens with a point, k of them before a small letter);
    'item' and 'prose' (finished lines, k of them with a mark); 'closing' (words that end a finished line without one)."""
    for batch in batches:
        n, k = Counter(), Counter()
        texts = batch.column(0).to_pylist()
        n["rows", ""] = len(texts)
        for text in texts:
            if not text:
                continue
            for token, letter in _SHORT.findall(text):
                n["short", token] += 1
                k["short", token] += letter.islower()
            for line in text.rstrip().split("\n")[:-1]:
                line = line.strip()
                if not line or (line[0] in "#*_`~" and (_HEADING.fullmatch(line) or _FENCE.match(line))):
                    continue
                kind = "item" if _ITEM.match(line) else "prose"
                ended = line[-1] in ".!?" or bool(_ENDED.search(line))
                n[kind, ""] += 1
                k[kind, ""] += ended
                if not ended and line[-1].isalpha():
                    n["closing", _WORD.findall(line)[-1].lower()] += 1
        keys = list(n)
        columns = [[x[0] for x in keys], [x[1] for x in keys], [n[x] for x in keys], [k[x] for x in keys]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int64()))], ["kind", "token", "n", "k"])


def learnt_ends(df: DataFrame, text_col: str = "output", min_count: int = 3, min_share: float = 1e-5) -> Ends:
    """The model of ends, counted over the whole column in one pass, where the rows are.

    An abbreviation is a token of few letters and points that small letters follow more often than capital ones. Lines
    are finished if another one follows. Tokens need min_share of the rows, so that there are few, whatever the size.
    """
    counted = df.select(F.col(f"`{text_col}`")).mapInArrow(_count_ends, "kind string, token string, n bigint, k bigint").groupBy("kind", "token").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    counted = cut(counted, "ends")
    rows = counted.filter("kind = 'rows'").agg(F.sum("n")).first()[0] or 0
    least = max(min_count, rows * min_share)
    kept = counted.filter(F.col("kind").isin("item", "prose") | ((F.col("n") >= least) & ((F.col("kind") == "closing") | ((F.col("kind") == "short") & (F.col("k") * 2 > F.col("n"))))))
    found: dict[str, list] = {"short": [], "item": [], "prose": [], "closing": []}
    for r in kept.collect():
        found[r.kind].append(r)
    marked = tuple((kind, r.k / r.n) for kind in ("item", "prose") for r in found[kind])
    return Ends(frozenset(r.token for r in found["short"]), marked, frozenset(r.token for r in found["closing"]))


def defects(df: DataFrame, key_col: str = "example_id", cols: tuple[str, str, str] = ("instruction", "input", "output")) -> DataFrame:
    """key_col and defect of every defective row; a row has at most one, judged in the order of `defect`.

    Null instructions and inputs are empty ones. Repeated rows each count. Other columns are ignored. An empty df gives
    no rows.
    """
    ends = learnt_ends(df, cols[2])
    kind = df.schema[key_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maybe = pa.compute.match_substring_regex(batch.column(3), _MAY_DECLINE, ignore_case=True).to_pylist()
            labels = [defect(i, p, o, ends, m) for i, p, o, m in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), maybe)]
            out = pa.RecordBatch.from_arrays([batch.column(0), pa.array(labels, pa.string())], [key_col, "defect"])
            yield out.filter(pa.compute.is_valid(out.column(1)))

    return df.select(F.col(f"`{key_col}`"), *[F.col(f"`{c}`") for c in cols]).mapInArrow(run, f"`{key_col}` {kind}, defect string")
