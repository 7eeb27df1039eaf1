"""Plain versions of the operators, for comparison."""

import hashlib
import re
from collections import Counter, defaultdict

import xxhash

SPACES = " \t\n\x0b\x0c\r"
LOWER = {i: i + 32 for i in range(65, 91)}


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def simhash(text):
    found = words((text or "").translate(LOWER))
    shingles = [" ".join(found[i : i + 3]) for i in range(len(found) - 2)] if len(found) >= 3 else [" ".join(found)] if found else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(fps, budget=3):
    """Least place of the group of each fingerprint in a list."""
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for j in range(i):
            if (a ^ fps[j]).bit_count() <= budget:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [find(i) for i in range(len(fps))]


def kept_lines(rows, least=10):
    """(n_lines, n_dropped, kept text) of each (doc_id, text)."""
    holders = defaultdict(set)
    key = lambda line: line.strip(SPACES).translate(LOWER)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if doc is not None and len(key(line)) >= least:
                holders[key(line)].add(doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        keep = [x for x in lines if doc is None or len(holders[key(x)]) < 2 or min(holders[key(x)]) == doc]
        out.append((len(lines), len(lines) - len(keep), "\n".join(keep)))
    return out


def quality_counts(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    found, body = words(text), text or ""
    lines = [x for x in body.split("\n") if words(x)]
    windows = [tuple(found[i : i + 5]) for i in range(len(found) - 4)]
    times = Counter(windows)
    covered = {p for i, w in enumerate(windows) if times[w] > 1 for p in range(i, i + 5)}
    return len(found), sum(map(len, found)), sum(c in "#*$%&|<>" for c in body), len(lines) - len(set(lines)), len(covered)


def sha(text):
    return hashlib.sha256((text or "").encode()).hexdigest()
