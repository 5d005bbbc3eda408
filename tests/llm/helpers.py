"""A small table with every awkward case, and brute-force versions of the operators."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, lines string, gone int, "
    "words string, node bigint, component int, _key_a string, chunk int, hash double, n_words int"
)
# columns whose names the operators use inside
EXTRA = ("r", "l", 7, "w", 3, 5, "a", 1, 0.5, None)


def lower_words(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def make_docs(seed=7):
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("abdeghilnorst") for _ in range(rnd.randint(2, 9))) for _ in range(900)]

    def line(n):
        return " ".join(rnd.choice(vocabulary) for _ in range(n)).capitalize() + rnd.choice(".,!")

    def text(k, n=12):
        return "\n".join(line(rnd.randint(max(2, n - 4), n + 4)) for _ in range(k))

    base = [text(rnd.randint(1, 9)) for _ in range(30)]
    shared = text(6)
    items = [(i, line(rnd.randint(15, 40))) for i in range(8)]
    items += [(100, "Two words"), (101, items[0][1]), (102, None), (103, ""), (None, items[1][1]), (104, "x y z 1 2"), (100, items[2][1])]
    out = list(base)
    out += base[:4] + [base[5].upper(), base[6].replace(".", " ;")]  # copies
    for b in (base[7], base[8], base[9]):  # near copies of three strengths
        for changes in (1, 4, 12):
            w = b.split(" ")
            for _ in range(changes):
                w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
            out.append(" ".join(w))
    out += [text(2) + "\n" + shared + "\n" + text(1), shared, shared + "\n" + text(3), text(1) + "\n" + shared]
    out += [text(2) + "\n" + items[0][1] + "\n" + text(2), items[1][1], items[2][1][: len(items[2][1]) // 2], "say TWO, words x y z 1 2"]
    out += [None, "", " ", "\n\n\n", "one", "one", "a b c d", "é É ü Ü ß\xa0x　y 日本語 <|endoftext|> don't 'S ..", "\t\x0b\x0c\r x\x1cy"]
    out += [text(700), "z" * 50_000, "k " * 20_000, "\n".join(["same line"] * 300)]
    rows = [(i, t, "en", "s", None if t is None else len(t), *EXTRA) for i, t in enumerate(out)]
    rnd.shuffle(rows)
    rows += [rows[3], rows[3], (None, base[10], None, None, None, *EXTRA), (None, text(3), None, None, None, *EXTRA), (None, None, None, None, None, *EXTRA)]
    rows.append((rows[4][0], text(2), "en", "s", 1, *EXTRA))  # an id with two texts
    return rows, items


def substring(rows, window=13):
    least, words = {}, []
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")
        words.append((r[0], w))
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            least[key] = min(least.get(key, 1 << 63), 1 << 62 if r[0] is None else r[0])
    out = []
    for d, w in words:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if least[tuple(w[i : i + window])] < (1 << 62 if d is None else d):
                gone[i : i + window] = [True] * window
        out.append((d, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


def contamination(rows, items, window=13):
    windows = defaultdict(set)
    for item, text in items:
        w = lower_words(text)
        m = min(window, len(w))
        for i in range(len(w) - m + 1 if w else 0):
            windows[tuple(w[i : i + m])].add("" if item is None else str(item))
    sizes = {len(k) for k in windows}
    out = []
    for r in rows:
        w = lower_words(r[1])
        hit, found = set(), set()
        for m in sizes:
            for i in range(len(w) - m + 1):
                ids = windows.get(tuple(w[i : i + m]))
                if ids:
                    found |= ids
                    hit.update(range(i, i + m))
        out.append((r[0], len(w), len(hit), len(found), ",".join(sorted(found))))
    return out


def gram_sets(rows, gram=5):
    out = []
    for r in rows:
        w = lower_words(r[1])
        n = min(gram, len(w))
        out.append(frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else frozenset())
    return out


def links(rows):
    """(doc_id, class_id, n_links) by comparing all pairs."""
    sets = gram_sets(rows)
    n = len(rows)
    part = list(range(n))

    def top(i):
        while part[i] != i:
            i = part[i]
        return i

    count = [0] * n
    for i in range(n):
        for j in range(i):
            if sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                count[i] += 1
                count[j] += 1
                a, b = top(i), top(j)
                part[max(a, b)] = min(a, b)
    least = {}
    for i, r in enumerate(rows):
        ids = [x for x in (least.get(top(i)), r[0]) if x is not None]
        least[top(i)] = min(ids) if ids else None
    return [(r[0], least[top(i)] if sets[i] else r[0], count[i]) for i, r in enumerate(rows)], [top(i) for i in range(n)], sets


def line_chunks(text, times=1_000_003, modulus=1_000_000_007, spacing=2):
    lines = (text or "").split("\n")
    h = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in lines]
    meets = [i > 1 and (h[i - 2] * times + h[i - 1]) % modulus % spacing == 0 for i in range(len(lines))]
    starts = [i for i in range(len(lines)) if i == 0 or meets[i] and not meets[i - 1]]
    return [(a, lines[a:b]) for a, b in zip(starts, [*starts[1:], len(lines)])]


def lines_left(rows):
    first = {}
    for r in rows:
        for start, body in line_chunks(r[1]):
            place = (r[0] is not None, r[0] or 0, start)
            key = "\n".join(body)
            first[key] = min(first.get(key, place), place)
    out = []
    for r in rows:
        kept, gone = [], 0
        for start, body in line_chunks(r[1]):
            several = len(body) >= 2 and sum(x.strip(" ") != "" for x in body) >= 2
            if several and first["\n".join(body)] != (r[0] is not None, r[0] or 0, start):
                gone += len(body)
            else:
                kept += body
        out.append((r[0], "\n".join(kept) if gone else r[1], len((r[1] or "").split("\n")), gone))
    return out


def crc(ids):
    return zlib.crc32(b"".join(int(i).to_bytes(4, "little") for i in ids))


def multiset(rows):
    return Counter(tuple(r) for r in rows)
