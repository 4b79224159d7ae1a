"""Plain versions of the operators, for small tables."""

import hashlib
import re
import string
from collections import Counter, defaultdict

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def documents(spark, rows, schema="doc_id long, text string, lang string, source string, n_chars long"):
    return spark.createDataFrame(rows, schema)


def texts(spark, values):
    return documents(spark, [(k, t, "en", "s", None if t is None else len(t)) for k, t in enumerate(values)])


def blank_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingle_set(text, width=5):
    words = blank_words((text or "").translate(LOWER))
    if not words:
        return set()
    if len(words) < width:
        return {tuple(words)}
    return {tuple(words[k:k + width]) for k in range(len(words) - width + 1)}


def plain_components(rows):
    """{doc_id: (n_shingles, component)} by comparing all pairs."""
    sets = {d: shingle_set(t) for d, t in rows}
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    return {d: (len(sets[d]), root(d)) for d in ids}


def plain_contamination(docs, items, window=13):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = defaultdict(set)
    for item, text in items:
        words = pattern.findall((text or "").translate(LOWER))
        size = min(window, len(words))
        for k in range(len(words) - size + 1 if size else 0):
            windows[tuple(words[k:k + size])].add(str(item))
    sizes = {len(w) for w in windows}
    out = {}
    for doc, text in docs:
        words = pattern.findall((text or "").translate(LOWER))
        hit, found = set(), set()
        for size in sizes:
            for k in range(len(words) - size + 1):
                if own := windows.get(tuple(words[k:k + size])):
                    hit.update(range(k, k + size))
                    found |= own
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out[doc] = (len(words), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(words))
    return out


def plain_removals(rows, length=200):
    """{doc_id: (n_bytes, n_removed, n_spans, sha256 of the rest)}."""
    counts = Counter()
    data = {d: (t or "").encode() for d, t in rows}
    for text in data.values():
        counts.update(text[k:k + length] for k in range(len(text) - length + 1))
    out = {}
    for doc, text in data.items():
        gone = bytearray(len(text))
        for k in range(len(text) - length + 1):
            if counts[text[k:k + length]] > 1:
                gone[k:k + length] = b"\x01" * length
        kept = bytes(b for b, g in zip(text, gone) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out[doc] = (len(text), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out
