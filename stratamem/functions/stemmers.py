"""Suffix-stripping stemmers for English (after Porter2) and Italian (after Snowball), as plain functions of one word."""

from __future__ import annotations

import re
from functools import lru_cache

_IRREGULAR = dict(pair.split(":") for pair in "skis:ski skies:sky dying:die lying:lie tying:tie idly:idl gently:gentl ugly:ugli early:earli only:onli singly:singl".split())
_FIXED = frozenset("andes atlas bias cosmos howe news".split())
_AFTER_PLURAL = frozenset("canning earring exceed herring inning outing proceed succeed".split())
_STEP2 = [p.split(">") for p in "ational>ate tional>tion enci>ence anci>ance izer>ize abli>able alli>al entli>ent eli>e ousli>ous ization>ize ation>ate ator>ate alism>al iveness>ive fulness>ful ousness>ous aliti>al iviti>ive biliti>ble logi>log".split()]
_STEP3 = [p.split(">") for p in "icate>ic ative> alize>al iciti>ic ical>ic ful> ness>".split()]
_STEP4 = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize".split()


def _vowel(w: str, i: int) -> bool:
    """A y counts as a vowel after a consonant."""
    if not 0 <= i < len(w):
        return False
    return w[i] in "aeiou" or (w[i] == "y" and i > 0 and w[i - 1] not in "aeiou")


def _after_syllable(w: str, start: int) -> int:
    """The place after the first consonant that follows a vowel."""
    return next((i + 1 for i in range(start, len(w)) if _vowel(w, i - 1) and not _vowel(w, i)), len(w))


def _short(w: str) -> bool:
    """Whether the word ends in consonant, vowel, consonant (but w, x, y), or is vowel and consonant."""
    n = len(w)
    if n == 2:
        return _vowel(w, 0) and not _vowel(w, 1)
    return n > 2 and not _vowel(w, n - 3) and _vowel(w, n - 2) and not _vowel(w, n - 1) and w[-1] not in "wxy"


def _swap(w: str, region: int, old: str, new: str) -> str | None:
    return w[: len(w) - len(old)] + new if w.endswith(old) and len(w) - len(old) >= region else None


def _past_and_gerund(w: str, r1: int) -> str:
    if w.endswith(("eed", "eedly")):
        return _swap(w, r1, "eed", "ee") or _swap(w, r1, "eedly", "ee") or w
    tail = next((t for t in ("edly", "ed", "ingly", "ing") if w.endswith(t)), None)
    if tail is None:
        return w
    root = w[: -len(tail)]
    if not any(_vowel(root, i) for i in range(len(root))):
        return w
    if root.endswith(("at", "bl", "iz")):
        return root + "e"
    if len(root) > 1 and root[-1] == root[-2]:
        return root if root[-1] in "lsz" else root[:-1]
    return root + "e" if _short(root) and _after_syllable(root, 1) == len(root) else root


@lru_cache(maxsize=100_000)
def english(word: str) -> str:
    """The stem of a lower-case word."""
    if len(word.encode()) <= 2 or word in _FIXED:
        return word
    if word in _IRREGULAR:
        return _IRREGULAR[word]
    w = word.removeprefix("'")
    if w.startswith("y"):
        w = "Y" + w[1:]
    r1 = _after_syllable(w, 1)
    r2 = _after_syllable(w, r1 + 1)
    w = re.sub(r"('s'|'s|')$", "", w)
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss") and len(w) > 2 and any(_vowel(w, i) for i in range(len(w) - 1)):
        w = w[:-1]
    if w in _AFTER_PLURAL:
        return w
    w = _past_and_gerund(w, r1)
    if len(w) > 2 and w[-1] in "yY" and not _vowel(w, len(w) - 2):
        w = w[:-1] + "i"
    w = next((s for old, new in _STEP2 if (s := _swap(w, r1, old, new)) is not None), w)
    w = next((s for old, new in _STEP3 if (s := _swap(w, r2 if old == "ative" else r1, old, new)) is not None), w)
    if w.endswith(("sion", "tion")) and len(w) - 3 >= r2:
        w = w[:-3]
    else:
        w = next((s for old in _STEP4 if (s := _swap(w, r2, old, "")) is not None), w)
    if w.endswith("e") and len(w) - 1 >= r1 and not (_short(w[:-1]) and _after_syllable(w[:-1], 1) == len(w) - 1):
        w = w[:-1]
    if w.endswith("ll") and len(w) - 2 >= r1:
        w = w[:-1]
    return w.lower()


_ACUTE = str.maketrans("áéíóú", "àèìòù")
_PRONOUNS = sorted("ci gli la le li lo mi ne si ti vi sene gliela gliele glieli glielo gliene mela mele meli melo mene tela tele teli telo tene cela cele celi celo cene vela vele veli velo vene".split(), key=len, reverse=True)
_VERBS = sorted(
    """ammo ando ano are arono asse assero assi assimo ata ate ati ato ava avamo avano avate avi avo emmo enda ende endi endo
    erà erai eranno ere erebbe erebbero erei eremmo eremo ereste eresti erete erò erono essero ete eva evamo evano evate evi evo
    iamo iate immo irà irai iranno ire irebbe irebbero irei iremmo iremo ireste iresti irete irò irono isca iscano isce isci isco
    iscono issero ita ite iti ito iva ivamo ivano ivate ivi ivo ono uta ute uti uto ar ir""".split(),
    key=len,
    reverse=True,
)
_SUFFIXES = [
    ("r2", "", "anza anze ico ici ica ice iche ichi ismo ismi abile abili ibile ibili ista iste isti istà istè istì oso osi osa ose mente atrice atrici ante anti".split()),
    ("r2ic", "", "azione azioni atore atori".split()),
    ("r2", "log", "logia logie".split()),
    ("r2", "u", "uzione uzioni usione usioni".split()),
    ("r2", "ente", "enza enze".split()),
    ("rv", "", "amento amenti imento imenti".split()),
    ("amente", "", ["amente"]),
    ("ità", "", ["ità"]),
    ("ivo", "", "ivo ivi iva ive".split()),
]
_BY_LENGTH = sorted(((s, region, new) for region, new, group in _SUFFIXES for s in group), key=lambda x: -len(x[0]))


def _italian_regions(w: str) -> tuple[int, int, int]:
    vowel = lambda i: w[i] in "aeiouàèìòù"
    n = len(w)
    after = lambda start: next((i + 1 for i in range(start, n) if vowel(i - 1) and not vowel(i)), n)
    r1 = after(1)
    r2 = after(r1 + 1)
    if n < 3:
        rv = n
    elif not vowel(1):
        rv = next((i + 1 for i in range(2, n) if vowel(i)), n)
    elif vowel(0):
        rv = next((i + 1 for i in range(2, n) if not vowel(i)), n)
    else:
        rv = 3
    return r1, r2, rv


def _italian_suffix(w: str, r1: int, r2: int, rv: int) -> str | None:
    """The word after the standard suffix step, or None if it took nothing."""
    for suffix, region, new in _BY_LENGTH:
        if not w.endswith(suffix):
            continue
        at = len(w) - len(suffix)
        root = w[:at]
        drop = lambda root, *ends: next((root[: -len(e)] for e in ends if root.endswith(e) and len(root) - len(e) >= r2), root)
        if region == "rv":
            return root if at >= rv else None
        if region == "amente":
            if at < r1:
                return None
            short = drop(root, "iv")
            return drop(short, "at") if short != root else drop(root, "abil", "os", "ic")
        if at < r2:
            return None
        if region == "r2ic":
            return drop(root, "ic")
        if region == "ità":
            return drop(root, "abil", "ic", "iv")
        if region == "ivo":
            short = drop(root, "at")
            return drop(short, "ic") if short != root else root
        return root + new
    return None


@lru_cache(maxsize=100_000)
def italian(word: str) -> str:
    """The stem of a lower-case word, accents folded at the end."""
    w = word.translate(_ACUTE)
    w = re.sub("qu", "qU", w)
    w = re.sub("(?<=[aeiouàèìòù])([ui])(?=[aeiouàèìòù])", lambda m: m[1].upper(), w)
    r1, r2, rv = _italian_regions(w)
    for p in _PRONOUNS:
        if w.endswith(p):
            root = w[: -len(p)]
            if root.endswith(("ando", "endo")) and len(root) - 4 >= rv:
                w = root
            elif root.endswith(("ar", "er", "ir")) and len(root) - 2 >= rv:
                w = root + "e"
            break
    done = _italian_suffix(w, r1, r2, rv)
    if done is not None:
        w = done
    else:
        end = next((v for v in _VERBS if w.endswith(v) and len(w) - len(v) >= rv), None)
        w = w[: -len(end)] if end else w
    if w and w[-1] in "aeioàèìò" and len(w) - 1 >= rv:
        w = w[:-1]
        if w.endswith("i") and len(w) - 1 >= rv:
            w = w[:-1]
    if w.endswith(("ch", "gh")) and len(w) - 1 >= rv:
        w = w[:-1]
    return w.lower().translate(str.maketrans("àèìòù", "aeiou"))
