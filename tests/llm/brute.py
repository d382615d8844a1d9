"""Plain versions of the operators' contracts over lists of (doc_id, text)."""

import re
import zlib
from fractions import Fraction
from hashlib import sha256

import numpy as np

BLANK_WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
SHA = lambda s: sha256(s.encode()).hexdigest()


def secrets(text):
    text = text or ""
    spans = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    spans += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    spans += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    count = [sum(s[1] == k for s in spans) for k in range(3)]
    return (*count, SHA(",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(spans))))


def spans(text, rules):
    """All spans of (kind, pattern, group, least length) by start, then rule."""
    found = [
        (m.start(), k, m.end(), kind)
        for k, (kind, pattern, group, least) in enumerate(rules)
        for m in re.finditer(pattern, text or "", re.ASCII)
        if len(m[group]) >= least
    ]
    return sorted(found)


def redacted(text, found):
    out, at = [], 0
    for start, _, end, _ in found:
        if start >= at:
            out += [text[at:start], "[SECRET]"]
        at = max(at, end)
    return None if text is None else "".join(out) + text[at:]


def shingles(text):
    words = BLANK_WORD.findall((text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 4]) for i in range(max(1, len(words) - 3)))


def near_duplicates(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in rows if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and i is not None and j is not None:
                both = len(a & b)
                if 100 * both >= 80 * (len(a) + len(b) - both):
                    x, y = find(i), find(j)
                    parent[max(x, y)] = min(x, y)
    return [(i, len(s), None if i is None else find(i), True if i is None else find(i) == i) for i, s in sets]


RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))


def url(value, rules=RULES):
    host = path = ""
    if value is not None and "://" in value:
        rest = value[value.index("://") + 3 :]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.translate(LOWER)
    fits = [(-len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, min(fits)[1], min(fits)[2]) if fits else (host, path, None, "allow")


def quality(text):
    text = text or ""
    words = BLANK_WORD.findall(text)
    where = {}
    for i in range(len(words) - 7):
        where.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {p + k for at in where.values() if len(at) > 1 for p in at for k in range(8)}
    lines = [x for x in text.split("\n") if BLANK_WORD.search(x)]
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed)


def decontaminate(rows, items):
    windows = {}
    for item, text in items:
        w = ALNUM_WORD.findall((text or "").translate(LOWER))
        n = min(13, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(item)
    sizes = {len(w) for w in windows}
    out = []
    for doc, text in rows:
        w = ALNUM_WORD.findall((text or "").translate(LOWER))
        hit, named = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                found = windows.get(tuple(w[i : i + n]))
                if found:
                    hit |= set(range(i, i + n))
                    named |= found
        names = sorted(str(x) for x in named)
        out.append((doc, len(w), len(hit), len(names), SHA(",".join(names)), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


def substring_dedup(rows):
    words = [(i, BLANK_WORD.findall(t or "")) for i, t in rows]
    least = {}
    for i, w in words:
        if i is not None:
            for k in range(len(w) - 12):
                key = tuple(w[k : k + 13])
                least[key] = min(i, least.get(key, i))
    out = []
    for i, w in words:
        gone = set()
        if i is not None:
            for k in range(len(w) - 12):
                if least[tuple(w[k : k + 13])] < i:
                    gone |= set(range(k, k + 13))
        out.append((i, len(w), len(gone), SHA(" ".join(x for k, x in enumerate(w) if k not in gone))))
    return out


def crc(text):
    return zlib.crc32((text or "").encode())


def made_periodic(doc, words):
    """The words of a document as the contract of periodic runs changes them."""
    n, h = len(words), None if doc is None else zlib.crc32(str(doc).encode())
    if h is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def runs(words):
    """(start, length, period) of all maximal stretches of smallest period q, length >= max(6, 4 q): each period over all words."""
    number, found = {}, {}
    ids = np.array([number.setdefault(w, len(number)) for w in words])
    for q in range(1, len(words) // 4 + 1):
        change = np.flatnonzero(np.diff((ids[:-q] == ids[q:]).astype(int), prepend=0, append=0))
        for i, j in zip(change[::2].tolist(), change[1::2].tolist(), strict=True):
            if j - i + q >= max(6, 4 * q):
                found.setdefault((i, j - i + q), q)
    return sorted((a, n, q) for (a, n), q in found.items())


def periodic(doc, text):
    words = made_periodic(doc, BLANK_WORD.findall(text or ""))
    found, gone = runs(words), set()
    for a, n, q in found:
        gone |= set(range(a + q, a + n))
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    tail = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    return (doc, len(found), *tail, SHA("".join(f"{a},{n},{q}\n" for a, n, q in found)), SHA(" ".join(w for i, w in enumerate(words) if i not in gone)))


BLANK_END = re.compile(r"[\x20\x09-\x0D]+\Z")
LANGUAGE = re.compile(r"(s?(ua)+)?\Z")


def order(row):
    turn, role, text = row
    return (turn is not None, turn or 0, role, text[:32], sha256(text.encode()).digest())


def damage(rows):
    """conv_id -> (turn, role, text) of the damaged rows, in order."""
    out = {}
    for conv, turn, role, text in rows:
        held = out.setdefault(conv, [])
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        v = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if v == 1 else re.sub("[.!?]", "", text) if v == 2 else text
        held += [(turn, "user" if v == 4 else role, text)] * (0 if v == 0 else 2 if v == 3 else 1)
    return {conv: sorted(held, key=order) for conv, held in out.items()}


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = BLANK_END.sub("", text)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, kinds):
    """Least (cost, audit) by value iteration over (rows read, initials so far by the language's states)."""
    states = {"": (None, "s", "u"), "s": ("u",), "u": ("a",), "a": ("u",)}  # what may follow
    best = {"": (0, "")}
    for i in range(len(rows) + 1):
        for _ in range(3):  # rows to insert
            for state, (cost, audit) in list(best.items()):
                to = "a" if state == "u" else "u"
                best[to] = min(best.get(to, (1 << 60, "")), (cost + 2, audit + "I"))
        if i == len(rows):
            break
        after = {}
        for state, (cost, audit) in best.items():
            initial, more = rows[i][1][:1], kinds[i] == "truncated"
            offers = [(state, cost + 3, audit + "D")]
            if kinds[i] not in ("blank", "duplicate"):
                if initial and initial in states[state]:
                    offers.append((initial, cost + more, audit + "K"))
                offers.append(("a" if state == "u" else "u", cost + 2 + more, audit + "R"))
            for to, *path in offers:
                after[to] = min(after.get(to, (1 << 60, "")), tuple(path))
        best = after
    return min(best[s] for s in ("", "a") if s in best)


def repair(conv, rows):
    kinds = faults(rows)
    cost, audit = cheapest(rows, kinds)
    out, left, state = [], iter(rows), ""
    for edit in audit:
        row = None if edit == "I" else next(left)
        if edit == "D":
            continue
        to = "a" if state == "u" else "u"
        role, text = ({"a": "assistant", "u": "user"}[to], "" if row is None else row[2]) if edit in "IR" else row[1:]
        state = role[0]
        out.append((role, text))
    assert LANGUAGE.match("".join(r[0] for r, _ in out))
    turns = [t for t, _, _ in rows if t is not None]
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (conv, gaps, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, SHA("\n".join(f"{r}:{t}" for r, t in out)))
