"""Plain versions of the text operators, a document at a time, to hold results against."""

import hashlib
import re
from collections import defaultdict

BLANKS = " \t\n\x0b\x0c\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def line_dedup(docs):
    """[(doc_id, text)] with distinct doc_ids -> {doc_id: (n_lines, n_dropped, kept)}"""
    key = lambda x: x.strip(BLANKS).translate(LOWER)
    holders = defaultdict(set)
    for i, t in docs:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 20:
                holders[key(x)].add(i)
    out = {}
    for i, t in docs:
        lines = (t or "").split("\n")
        stay = [x for x in lines if len(holders.get(key(x), ())) < 3 or i == max(holders[key(x)])]
        out[i] = (len(lines), len(lines) - len(stay), "\n".join(stay))
    return out


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def near_dups(docs, percent=80):
    """[(doc_id, text)] -> {doc_id: (n_shingles, component_id)}"""
    sets, root = {i: shingles(t) for i, t in docs}, {i: i for i, _ in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(digits[::-1])) % 10 == 0


def base_spans(text):
    out = []
    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and luhn(d)),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(re.sub("[^0-9]", "", m)) <= 15),
    ]
    for k, (kind, rx, ok) in enumerate(rules):
        out += [(m.start(), k, m.end(), kind) for m in re.finditer(rx, text or "") if ok(m[0])]
    return [(kind, a, b) for a, _, b, kind in sorted(out)]


def quality_base(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words"""
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen = defaultdict(list)
    for i in range(len(w) - 2):
        seen[tuple(w[i : i + 3])].append(i)
    covered = {p + d for at in seen.values() if len(at) > 1 for p in at for d in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)
