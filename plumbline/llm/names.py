"""Parsing and comparing organisation names: folding, kinds, phonetic codes, Jaro-Winkler."""

from __future__ import annotations

import itertools
import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import regex

#: Words of each kind of body, in full and as dictionaries shorten them. Other spellings and kinds are
#: learned from the names (variants.learn_vocabulary).
KINDS = {
    "university": ["university", "univ", "universidad", "universite", "universitat", "universita", "uni"],
    "institute": ["institute", "inst", "institut", "instituto"],
    "hospital": ["hospital", "hosp", "krankenhaus"],
    "laboratory": ["laboratory", "laboratories", "lab", "labs"],
    "observatory": ["observatory", "obs", "observatorium"],
    "bank": ["bank", "banco", "banque"],
    "consulting": ["consulting", "cons", "consultancy"],
    "technologies": ["technologies", "technology", "tech"],
    "robotics": ["robotics"],
    "college": ["college"],
    "software": ["software"],
    "systems": ["systems", "sys"],
    "analytics": ["analytics"],
    "digital": ["digital"],
    "infotech": ["infotech"],
    "data services": ["dataservices"],
    "academy": ["academy", "akademie", "academia"],
    "agency": ["agency", "agentur", "agencia"],
    "association": ["association", "assoc", "verband"],
    "clinic": ["clinic", "klinik", "clinica"],
    "council": ["council"],
    "foundation": ["foundation", "stiftung", "fundacion"],
    "insurance": ["insurance", "versicherung"],
    "library": ["library", "bibliothek", "biblioteca"],
    "ministry": ["ministry", "ministerium", "ministerio"],
    "museum": ["museum", "museo"],
    "society": ["society"],
}
#: Words that qualify a kind or a legal form and name nobody.
FILLERS = set(
    "of for the de la le der das di del da do und national natl nat general gen research res applied appl app computing comp group grp"
    " inc incorporated ltd limited llc gmbh g m b h ag pvt private co corp corporation company plc sa s.a b.v bv s a v sarl srl oy kg the intl hq".split()
)
#: Entries that name no organisation.
NOBODY = set(
    "none|n/a|na|n.a.|null|-|--|.|?|unknown|unaffiliated|self-employed|self employed|freelance|freelancer|student|independent|independent researcher|retired|not available|nil|x|tbd|private|individual|no affiliation|not applicable".split(
        "|"
    )
)
#: Words that open the name of a department.
DEPARTMENTS = {"dept", "department", "faculty", "school", "division", "departamento", "abteilung"}
WORD_KIND = {w: kind for kind, words in KINDS.items() for w in words}
WORD = regex.compile(r"[\p{L}\p{N}]+")
CAMEL = regex.compile(r"(?<=\p{Ll})(?=\p{Lu})")
TWO = regex.compile(r"\s(?:and|und|y|et|&|\+)\s|\s/\s|;|\s\|\s")


@dataclass(frozen=True)
class Vocabulary:
    """What words mean in names: the kind of body they tell, or nothing."""

    kinds: dict[str, str]
    fillers: frozenset[str]


PLAIN = Vocabulary(WORD_KIND, frozenset(FILLERS))


def fold(text: str) -> str:
    """Letters without accents or ligatures, in lower case."""
    plain = unicodedata.normalize("NFKD", text)
    return "".join(ch for ch in plain if not unicodedata.combining(ch)).replace("ß", "ss").replace("ø", "o").replace("ł", "l").casefold()


@dataclass(frozen=True)
class Name:
    kind: str | None  # None: no word of a kind
    core: tuple[str, ...]  # the proper name's words, folded
    short: bool  # the first word of the core is cut by a full stop
    nick: str | None  # a short form the entry itself gives
    found: bool  # names exactly one organisation


NO_NAME = Name(None, (), False, None, False)


def _words(part: str, known: Vocabulary = PLAIN) -> list[tuple[str, bool]]:
    """(folded word, followed by a full stop) of a part; words glued in camel case come apart."""
    out = []
    for m in WORD.finditer(part):
        dot = part[m.end() : m.end() + 1] == "."
        whole = fold(m.group())
        if whole in known.fillers or whole in known.kinds:
            out.append((whole, dot))
            continue
        pieces = CAMEL.sub(" ", m.group()).split(" ")
        out += [(fold(p), dot and i == len(pieces) - 1) for i, p in enumerate(pieces)]
    return out


def _split(part: str, known: Vocabulary) -> tuple[str | None, list[tuple[str, bool]]]:
    kind, core = None, []
    words = _words(part, known)
    text = " ".join(w for w, _ in words)
    if "info tech" in text or "data services" in text:
        kind = "infotech" if "info tech" in text else "data services"
        words = [w for w in words if w[0] not in ("info", "tech", "data", "services")]
    for word, dot in words:
        if word in known.kinds:
            kind = kind or known.kinds[word]
        elif word not in known.fillers:
            core.append((word, dot))
    return kind, core


def parse_name(text: str | None, known: Vocabulary = PLAIN) -> Name:
    """The one organisation an entry names; ``found`` is False for none or two."""
    if text is None or fold(text).strip() in NOBODY or not WORD.search(text):
        return NO_NAME
    body = text.strip()
    nick = None
    bracket = regex.search(r"\(([^()]*)\)\s*$", body)
    dash = regex.search(r"\s(?:[-–]|[aA]\.?[kK]\.?[aA]\.?)\s+(\S+)\s*$", body)
    if bracket and len(WORD.findall(bracket.group(1))) == 1:
        nick, body = fold(bracket.group(1).strip()), body[: bracket.start()]
    elif bracket:
        inside = bracket.group(1)  # a short form may stand before the full name in brackets
        before = body[: bracket.start()].strip()
        if len(WORD.findall(before)) == 1:
            nick, body = fold(before), inside
    elif dash:
        nick, body = fold(dash.group(1)), body[: dash.start()]
    parts = [p for p in body.split(",") if WORD.search(p)]
    parts = [p for i, p in enumerate(parts) if not (i + 1 < len(parts) and _words(p, known)[0][0] in DEPARTMENTS)]
    body = ",".join(parts)
    if TWO.search(body):
        halves = [_split(h, known) for h in TWO.split(body) if WORD.search(h)]
        if sum(bool(core) for _, core in halves) > 1:
            return NO_NAME
    kind, core = None, []
    for part in parts:
        own_kind, own = _split(part, known)
        if own and not core:
            core = own
            kind = kind or own_kind
        elif own_kind and not own:
            kind = kind or own_kind
        # other parts after the name are places
    if not core:
        return NO_NAME
    words = tuple(w for w, _ in core)
    if len("".join(words)) < 3:
        return NO_NAME
    return Name(kind, words, core[0][1] and len(words) > 1, nick, True)


VOWELS = "aeiou"
#: Letters that sound alike.
SOUNDS = str.maketrans({"c": "k", "q": "k", "x": "s", "z": "s", "y": "i", "w": "v", "d": "t", "b": "p", "g": "k", "j": "k", "m": "n"})


def phonetic(word: str) -> str:
    """Consonants as they sound, doubled ones once, vowels dropped, the first letter's class kept."""
    plain = word.replace("ch", "k").replace("sh", "s").replace("ph", "f").translate(SOUNDS)
    out = []
    for i, ch in enumerate(plain):
        if ch in "aeiouh":
            if i == 0:
                out.append("a")
            continue
        if i == 0 or plain[i - 1] != ch:
            out.append(ch)
    return "".join(out)


def jaro_winkler(a: str, b: str, scale: float = 0.1) -> float:
    if a == b:
        return 1.0
    la, lb = len(a), len(b)
    if not la or not lb:
        return 0.0
    reach = max(la, lb) // 2 - 1
    used = [False] * lb
    matched = []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(lb, i + reach + 1)):
            if not used[j] and b[j] == ch:
                used[j] = True
                matched.append(ch)
                break
    m = len(matched)
    if not m:
        return 0.0
    other = [b[j] for j in range(lb) if used[j]]
    swaps = sum(x != y for x, y in zip(matched, other, strict=True)) / 2
    jaro = (m / la + m / lb + (m - swaps) / m) / 3
    prefix = sum(1 for _ in itertools.takewhile(lambda p: p[0] == p[1], zip(a[:4], b[:4])))
    return jaro + prefix * scale * (1 - jaro)


def edits(a: str, b: str) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours between two words."""
    before, row = [], list(range(len(b) + 1))
    for i, ch in enumerate(a, 1):
        new = [i]
        for j, other in enumerate(b, 1):
            cost = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (ch != other))
            if i > 1 and j > 1 and ch == b[j - 2] and a[i - 2] == other:
                cost = min(cost, before[j - 2] + 1)
            new.append(cost)
        before, row = row, new
    return row[-1]


def opening(word: str, vowels: int = 2) -> str:
    """The word up to its second vowel."""
    for i, ch in enumerate(word):
        if ch in VOWELS:
            vowels -= 1
            if not vowels:
                return word[: i + 1]
    return word


def short_forms(core: tuple[str, ...]) -> list[str]:
    """Short forms people make of a name: the openings of all words or of the first two put together, and of three words or more the initials."""
    if len(core) < 2 or any(w.isdigit() for w in core):
        return []
    forms = ["".join(opening(w) for w in core)]
    if len(core) > 2:
        forms += ["".join(opening(w) for w in core[:2]), "".join(w[0] for w in core)]
    return forms


def _consonants(word: str) -> str:
    return "".join(ch for ch in word if ch not in VOWELS)


def _within(short: str, long: str) -> bool:
    """The letters of ``short`` stand in ``long`` in that order."""
    rest = iter(long)
    return all(ch in rest for ch in short)


def _stands_for(word: str, full: str) -> bool:
    """The word may be a short or misspelt way to write ``full``: its beginning, its consonants, or a slip or two away."""
    if not word or word[0] != full[0]:
        return False
    stem = word[:-1] if word.endswith("s") and len(word) > 3 else word
    if len(stem) >= 3 and full.startswith(stem):
        return True
    if len(word) >= 2 and word == _consonants(word) and _within(word, _consonants(full)):
        return True
    return edits(word, full) <= (2 if len(word) >= 7 else 1 if len(word) >= 5 else 0)


def kind_of_word(word: str) -> str | None:
    """The one kind a word may stand for; None for none or several."""
    kinds = {kind for full, kind in WORD_KIND.items() if _stands_for(word, full)}
    return kinds.pop() if len(kinds) == 1 else None


@lru_cache(1 << 16)
def _letters(word: str) -> int:
    """The set of a word's letters, as bits; letters beyond 64 share bits."""
    bits = 0
    for ch in word:
        bits |= 1 << (ord(ch) & 63)
    return bits


def _far(a: str, b: str, most: int) -> bool:
    """More than ``most`` edits apart for sure: by length, or by letters that only one of them has."""
    one, two = _letters(a), _letters(b)
    return abs(len(a) - len(b)) > most or (one & ~two).bit_count() > most or (two & ~one).bit_count() > most


def _near(a: str, b: str, most: int) -> float:
    """Jaro-Winkler of two spellings of one word, 0 where they are too far apart."""
    if a == b:
        return 1.0
    if min(len(a), len(b)) < 4 or _far(a, b, most):
        return 0.0
    score = jaro_winkler(a, b)
    return score if score >= 0.8 and edits(a, b) <= most else 0.0


def _cut_near(x: str, y: str) -> bool:
    """The shorter word is the misspelt beginning of the longer one."""
    short, long = sorted((x, y), key=len)
    return not _far(short, long[: len(short)], 1) and edits(short, long[: len(short)]) == 1 and short.isalpha()


DIGITS = regex.compile(r"\D+")
NUMERALS = regex.compile(r"\d+")


def similarity(a: tuple[str, ...], b: tuple[str, ...], most: int = 2) -> float:
    """How alike two proper names are (0 to 1): word by word as written, reversed or sorted, or all in one word; 0 where they differ.

    A word of three or four letters counts as the beginning of a longer one.
    """
    best = 0.0
    if DIGITS.sub("", " ".join(sorted(a))) != DIGITS.sub("", " ".join(sorted(b))):
        return 0.0  # numbers are never misspelt
    if len(a) == len(b):
        orders = [(a, b), (a, b[::-1])][: len(b)]
        if len(b) > 2:
            orders.append((tuple(sorted(a)), tuple(sorted(b))))
        for own, other in orders:
            scores = []
            for x, y in zip(own, other, strict=True):
                if scores and not scores[-1]:
                    break  # one word that differs is enough
                if x != y and min(len(x), len(y)) <= 4 and (x.startswith(y) or y.startswith(x)) and len(a) > 1:
                    scores.append(0.9)
                elif x[0] == y[0] and min(len(x), len(y)) in (3, 4) and abs(len(x) - len(y)) > 1 and _cut_near(x, y):
                    scores.append(0.89)
                else:
                    scores.append(_near(x, y, most))
            if min(scores) > 0 and max(scores) > 0.9 and (0.89 not in scores or max(scores) == 1):
                best = max(best, sum(scores) / len(scores))
    if best < 1 and (len(a) != len(b) or best == 0):
        for joined in {"".join(a), "".join(reversed(a)), "".join(sorted(a))}:
            for other in {"".join(b), "".join(reversed(b)), "".join(sorted(b))}:
                score = _near(joined, other, most)
                if min(len(joined), len(other)) >= 8 and score >= 0.9:
                    best = max(best, score)
    return best


def _left_out(code: str) -> set[str]:
    """The code, and the code with each sound left out."""
    return {code, *(code[:i] + code[i + 1 :] for i in range(len(code)))}


def blocking_keys(core: tuple[str, ...]) -> list[str]:
    """Keys of which two spellings of a name share one, each with the name's digits, which are never misspelt.

    Phonetic codes of the words joined as written, reversed and sorted, and of
    two words apart, each also with any one sound left out, the first too; one
    word's code with another's first letter; of short names, the letters with
    up to two left out.
    """
    digits = DIGITS.sub("", " ".join(sorted(core)))
    words = [w for w in (NUMERALS.sub("", w) for w in core) if w]
    if not words:
        return ["n" + digits]
    codes = [phonetic(w) for w in words]
    keys = set()
    for joined in {"".join(words), "".join(reversed(words)), "".join(sorted(words))}:
        code = phonetic(joined)
        keys |= {f"j{c}" for c in (_left_out(code) if len(code) > 3 else {code})}
        if len(joined) <= 8:
            keys |= {f"d{x}" for once in _left_out(joined) for x in _left_out(once)}
    for i, code in enumerate(codes):
        keys |= {f"w{code}.{other[0]}" for j, other in enumerate(words) if i != j}
    if len(words) == 2:
        cuts = [_left_out(c) if len(c) > 1 else {c} for c in codes]
        keys |= {"s" + ".".join(sorted((x, y))) for x in cuts[0] for y in cuts[1]}
    return sorted(f"{k}#{digits}" if digits else k for k in keys)


def marks(core: tuple[str, ...]) -> tuple[int, int, int]:
    """(letters, length, least) of a proper name, from which ``variants.may_be_alike`` tells names that are surely not alike.

    ``letters``: the letters of the first and the second word as two sets of 31
    bits; of a name of one word or more than two, all letters as the first.
    ``length``: number of letters. ``least``: length of the shorter of two words,
    63 of one word, 0 of more than two, -100 of names with an empty word.
    """
    words = core if len(core) == 2 else ("".join(core),)
    sets = [0, 0]
    for i, word in enumerate(words):
        for ch in word:
            sets[i] |= 1 << ord(ch) % 31
    least = -100 if not all(core) else min(63, len(core[0]), len(core[1])) if len(core) == 2 else 63 if len(core) == 1 else 0
    return sets[0] << 32 | sets[1], sum(map(len, core)), least
