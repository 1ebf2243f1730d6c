"""Brute-force versions of the operators, over lists of (doc_id, text)."""

import bisect
import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile("[^\x20\x09-\x0d]+")


def repeats(docs, length=400):
    seen = Counter(b[i : i + length] for _, t in docs for b in [(t or "").encode()] for i in range(len(b) - length + 1))
    out = []
    for d, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = len(re.findall(b"\1+", bytes(gone)))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def kmers(text, k=5):
    w = WORD.findall(text or "")
    out, seen = [], Counter()
    for i in range(max(1, len(w) - k + 1) if w else 0):
        s = tuple(w[i : i + k])
        out.append((s, seen[s]))
        seen[s] += 1
    return out


def order_similarity(x, y):
    """m / (|x| + |y| - m) for the longest common subsequence of occurrence-labelled k-mers."""
    place = {s: j for j, s in enumerate(y)}
    ends = []
    from bisect import bisect_left

    for s in x:
        if s in place:
            at = bisect_left(ends, place[s])
            ends[at : at + 1] = [place[s]]
    m = len(ends)
    return m / (len(x) + len(y) - m) if x and y else 0.0


def classes(docs, least=0.8, ordered=True):
    """doc_id to the least doc_id of its class, over all pairs that share a k-mer, and equal texts.

    Not ordered: the k-mers are compared as sets.
    """
    root = {d: d for d, _ in docs}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    sets, holders, texts = {d: kmers(t) if ordered else sorted({(s, 0) for s, _ in kmers(t)}) for d, t in docs}, defaultdict(list), defaultdict(list)
    for d, t in docs:
        texts[t or ""].append(d)
    heads = [v[0] for v in texts.values()]
    for v in texts.values():
        for a in v[1:]:
            root[max(find(a), find(v[0]))] = min(find(a), find(v[0]))
    for d in heads:
        for s in sets[d]:
            holders[s].append(d)
    pairs = Counter((a, b) for v in holders.values() for i, a in enumerate(v) for b in v[i + 1 :])
    for (a, b), n in pairs.items():
        if n >= 0.5 * min(len(sets[a]), len(sets[b])) and order_similarity(sets[a], sets[b]) >= least:
            root[max(find(a), find(b))] = min(find(a), find(b))
    return {d: find(d) for d, _ in docs}


def quality_counts(text):
    w = WORD.findall(text or "")
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    again = {i + k for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for k in range(8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(again)


def taken(docs, targets, most=3):
    """doc_id to the words that the mix takes of it: slot after slot, each the next word of its source's shuffled documents."""
    size, of = {d: len(WORD.findall(t or "")) for d, t, _ in docs}, {}
    for d, _, s in docs:
        of.setdefault(s, []).append(d)
    names = sorted(of, key=lambda s: (s is None, s or ""))
    place = lambda d: int(hashlib.md5(f"7:{d}".encode()).hexdigest()[:15], 16)
    words = {s: [d for d in sorted(of[s], key=lambda d: (place(d) % 4096, place(d))) for _ in range(size[d])] for s in names}
    ends, upto = [], 0.0
    for s in names:
        ends.append(upto := upto + targets[s])
    slots = Counter(names[min(bisect.bisect_right(ends, i * 0.6180339887498949 % 1 * upto), len(names) - 1)] for i in range(sum(size.values())))
    out = dict.fromkeys(size, 0)
    for s, n in slots.items():
        for k in range(min(n, most * len(words[s]))):
            out[words[s][k % len(words[s])]] += 1
    return out


def edited(docs):
    """doc_id to edited text, by the order of descending doc_id."""
    rows = sorted(docs, key=lambda r: -r[0])
    out = {}
    for (d, t), (_, u) in zip(rows, rows[1:] + rows[:1]):
        t, u = t or "", u or ""
        n = len(t) // 3
        out[d] = t[: len(t) - n] + u[:n]
    return out


def line_runs(docs, run=3, long=50):
    """doc_id to (kept text, deleted lines): lines in runs (or long lines) that are equal to an earlier run that they don't overlap."""
    first, out = {}, {}
    for d, t in sorted(docs):
        lines = [(i, x.strip()) for i, x in enumerate((t or "").split("\n")) if x.strip()]
        gone = set()
        for i, n in [(i, run) for i in range(len(lines) - run + 1)] + [(i, 1) for i, (_, x) in enumerate(lines) if len(WORD.findall(x)) >= long]:
            key = tuple(x for _, x in lines[i : i + n])
            at = first.setdefault(key, (d, i))
            if at[0] != d or i >= at[1] + n:
                gone |= {lines[i + k][0] for k in range(n)}
        out[d] = ("\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone) if gone else t, len(gone))
    return out


def corpus(seed=5):
    """(doc_id, text, source) with exact and near copies, shared passages, repeated lines, junk and odd texts."""
    import random

    r = random.Random(seed)
    syllables = "the an in er on re th ou éa ment ción über ha ti st".split()
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    sentence = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    text = lambda lines: "\n".join(sentence(r.randint(6, 14)) for _ in range(lines))
    passage, docs = text(8), []
    for i in range(40):
        t = text(r.randint(3, 14))
        if i % 5 == 1:
            t += "\n" + passage + "\n" + text(2)
        docs.append(t)
    docs += [docs[3], docs[3], docs[7] + " " + docs[7], "", None, "one", "a b c", "x " * 300, ("| menu » entry | " * 40).strip(), "a" * 1500, "é" * 900 + " é", " \n \n", "ab  cd   ef \n\n  gh "]
    long_line = sentence(60)
    docs += [text(3) + "\n" + long_line + "\n" + text(2), long_line, text(2) + "\n  " + long_line + "\n" + text(1) + "\n" + long_line]
    for i in (2, 9, 16):
        for k in range(4):
            w = docs[i].split(" ")
            w[len(w) // 2 + k] = "changed"
            docs.append(" ".join(w))
    return [(d, t, ("src%d" % (d % 3)) if d % 11 else None) for d, t in enumerate(docs)]
