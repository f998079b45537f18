"""Plain versions of the operators, one document after the other."""

import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def removed_bytes(texts, length=100):
    """texts in order: (removed flags as runs, kept bytes) of each."""
    seen, out = set(), []
    for t in texts:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            w = raw[p : p + length]
            if w in seen:
                gone[p : p + length] = b"\1" * length
            else:
                seen.add(w)
        runs = [m.span() for m in re.finditer(b"\1+", bytes(gone))]
        out.append((runs, bytes(c for c, g in zip(raw, gone, strict=True) if not g)))
    return out


def statistics(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": again, "n_repeat_words": len(covered), "base_failed": failed}


def without_repeated_lines(texts, width=3):
    seen, out = set(), []
    for t in texts:
        lines = (t or "").split("\n")
        holds = [i for i, line in enumerate(lines) if WORD.search(line)]
        gone = set()
        for k in range(len(holds) - width + 1):
            w = tuple(lines[i] for i in holds[k : k + width])
            if w in seen:
                gone.update(range(k, k + width))
            seen.add(w)
        removed = {holds[k] for k in gone}
        out.append((len(removed), sum(k - 1 not in gone for k in gone), "\n".join(x for i, x in enumerate(lines) if i not in removed)))
    return out


def shingles(text):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def near_components(texts, percent=75):
    """Least index of each text's component."""
    sets = [shingles(t) for t in texts]
    label = list(range(len(texts)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                x, y = sorted((root(i), root(j)))
                label[y] = x
    return [root(i) for i in range(len(texts))], [len(s) for s in sets]


def mix_targets(sizes_by_source, most=3):
    names = sorted(sizes_by_source, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, capped = sum(sizes_by_source.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        if not free:
            return {s: float(most * sizes_by_source[s]) for s in names}
        rate = (total - sum(most * sizes_by_source[s] for s in capped)) / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * rate > most * sizes_by_source[s]}
        if not over:
            return {s: float(most * sizes_by_source[s]) if s in capped else weight[s] * rate for s in names}
        capped |= over


def sha(data):
    return hashlib.sha256(data).hexdigest()
