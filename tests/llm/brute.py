"""Plain Python versions of the operators, and awkward documents."""
import hashlib
import random
import re

SPACE = r"[^\x20\x09-\x0D]+"
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, r1 long, __key double, `a.b` string, size string"


def sha(b):
    return hashlib.sha256(b if isinstance(b, bytes) else b.encode()).hexdigest()


def lower(t):
    return (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def words(t, pattern=SPACE):
    return re.findall(pattern, t or "")


def covered(sequences, length, earlier_only=False):
    """For each sequence, which places are in a window that also starts elsewhere (earlier)."""
    count, first = {}, {}
    for d, s in enumerate(sequences):
        for i in range(len(s) - length + 1):
            k = tuple(s[i:i + length])
            count[k] = count.get(k, 0) + 1
            first.setdefault(k, (d, i))
    out = []
    for d, s in enumerate(sequences):
        c = [False] * len(s)
        for i in range(len(s) - length + 1):
            k = tuple(s[i:i + length])
            if count[k] > 1 and not (earlier_only and first[k] == (d, i)):
                c[i:i + length] = [True] * length
        out.append(c)
    return out


def repeated_bytes(rows, length, earlier_only=False):
    seqs = [(t or "").encode() for _, t in rows]
    out = []
    for (i, _), s, c in zip(rows, seqs, covered(seqs, length, earlier_only)):
        runs = sum(1 for a, b in zip([False] + c, c) if b and not a)
        out.append((i, len(s), sum(c), runs, sha(bytes(b for b, x in zip(s, c) if not x))))
    return out


def repeated_words(rows, length, earlier_only=False):
    seqs = [words(t) for _, t in rows]
    return [(i, len(s), sum(c), sha(" ".join(w for w, x in zip(s, c) if not x)))
            for (i, _), s, c in zip(rows, seqs, covered(seqs, length, earlier_only))]


def contamination(docs, items, window=10):
    grams = {}
    for item, t in items:
        w = words(lower(t), ALNUM)
        n = min(len(w), window)
        for i in range(len(w) - n + 1) if n else []:
            grams.setdefault(tuple(w[i:i + n]), set()).add(item)
    lengths = sorted({len(g) for g in grams})
    out = []
    for i, t in docs:
        w, found = words(lower(t), ALNUM), set()
        hit = [False] * len(w)
        for n in lengths:
            for k in range(len(w) - n + 1):
                if (g := tuple(w[k:k + n])) in grams:
                    hit[k:k + n] = [True] * n
                    found |= {str(x) for x in grams[g] if x is not None}
        out.append((i, len(w), sum(hit), len(found), sha(",".join(sorted(found))), any(hit)))
    return out


def base_counts(t):
    t = t or ""
    w = words(t)
    lines, dup, seen = t.split("\n"), 0, set()
    for x in lines:
        if words(x):
            dup += x in seen
            seen.add(x)
    grams = {}
    for i in range(len(w) - 7):
        grams.setdefault(tuple(w[i:i + 8]), []).append(i)
    rep = [False] * len(w)
    for at in grams.values():
        if len(at) > 1:
            for i in at:
                rep[i:i + 8] = [True] * 8
    failed = len(w) < 20 or 100 * sum(rep) > 30 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, sum(rep), failed


def fingerprint(t, shingle=3):
    import xxhash
    w = words(lower(t))
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(w[i:i + shingle]).encode(), 42) for i in range(max(1, len(w) - shingle + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components(fps, radius=3):
    """Index of the smallest member for every value, by all pairs."""
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(fps))]


def dedup_lines(rows, n=3):
    seen, out = set(), []
    for i, t in rows:
        lines = (t or "").split("\n")
        gone = set()
        for s in range(len(lines) - n + 1):
            k = tuple(lines[s:s + n])
            if "".join(k).strip(" \t\r\v\f") == "":
                continue
            if k in seen:
                gone |= set(range(s, s + n))
            seen.add(k)
        out.append((i, len(lines), len(gone), "\n".join(x for k, x in enumerate(lines) if k not in gone)))
    return out


def awkward(seed=3, n=60, vocabulary=("ab", "c", "dé", "E", "f1", "g,", "Hh", "$$")):
    """(doc_id, text) rows: nulls, empties, blanks, odd white space, copies,
    shared passages, periodic runs, a text of one long word."""
    r = random.Random(seed)
    passage = " ".join(r.choice(vocabulary) + str(r.randrange(9)) for _ in range(60))
    texts = [None, "", " ", "\n\n\n", "\t\v\f\r", "a", "ab ab", "x" * 300, "ab " * 120, "é" * 150, "   a\u0085b", passage, passage]
    for _ in range(n):
        t = r.choice([" ", "\n", "  "]).join(r.choice(vocabulary) + str(r.randrange(40)) for _ in range(r.randrange(1, 90)))
        if r.random() < 0.4:
            a = r.randrange(len(passage) // 2)
            t += r.choice([" ", "\n", ""]) + passage[a:a + r.randrange(20, 200)] + " " + r.choice(["", t[:30]])
        texts.append(t)
        if r.random() < 0.2:
            texts.append(t)
    return [(i * 7 % 1000, t) for i, t in enumerate(texts)]


def frame(spark, rows, partitions=3):
    """Rows as documents with columns whose names get in the way, some null."""
    full = [(i, t, None, ("s" + str(i % 3)) if i is not None and i % 4 else None, None, 1, None, "x", "y") for i, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(partitions)
