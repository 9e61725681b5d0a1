"""Plain one-document-at-a-time versions of what the queries must return."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np

WORD = re.compile("[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lower_words(text):
    return WORD.findall((text or "").translate(LOWER))


def remainder(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5


def id_bytes(ids):
    return np.array(ids, "<u4").tobytes()


def base_secrets(text):
    def either(word):
        return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)

    names = "|".join(map(either, ("password", "passwd", "secret", "token")))
    key = f"{either('api')}_?{either('key')}"
    assign = re.compile(rf"""(?:{names}|{key})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    found = []
    for order, (kind, pattern, group, least) in enumerate((
        ("assign", assign, 1, 6), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20),
        ("hex", re.compile("[0-9a-f]+"), 0, 24),
    )):
        found += [(m.start(), order, kind, m.end()) for m in pattern.finditer(text or "")
                  if len(m[group]) >= least]
    return ",".join(f"{kind}:{start}:{end}" for start, _, kind, end in sorted(found))


def entropy_class(window):
    """Class and threshold of a window of 20 characters, or None."""
    digits, upper, lower = (sum(c in "0123456789" for c in window), sum("A" <= c <= "Z" for c in window),
                            sum("a" <= c <= "z" for c in window))
    others = 20 - digits - upper - lower
    if digits >= 2 and upper + lower >= 2 and others <= 4:
        if all(c in "0123456789abcdefABCDEF" for c in window) and not (upper and lower):
            return "hex", 3.0
        return ("encoded", 3.8) if others else ("alnum", 3.6)
    turns = sum(a.isalpha() and b.isalpha() and a.isupper() != b.isupper() for a, b in zip(window, window[1:]))
    if digits < 2 and others <= 4 and upper >= 7 and lower >= 7 and turns >= 8:
        return "mixed", 3.6
    return None


def all_secrets(text):
    """Base spans and entropy spans of a text, window by window, as ``kind:start:end``."""
    text = text or ""
    base = [s.split(":") for s in base_secrets(text).split(",") if s]
    found = [(int(a), ("assign", "access", "hex").index(k), k, int(b)) for k, a, b in base]
    taken = [(a, b) for a, _, _, b in found]
    uuid = re.compile("[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
    for run in re.finditer("[A-Za-z0-9+/_=-]{20,}", text):
        own = run[0]
        if (uuid.fullmatch(own) or not re.search("[A-Za-z]", own) or re.match("www|https?", own)
                or len(set(own)) == 1):
            continue
        words = re.fullmatch("([A-Za-z]+[-_/+=])*[A-Za-z]+[0-9]{0,4}", own)
        spans = []
        for start in range(len(own) - 19):
            window = own[start:start + 20]
            kind = entropy_class(window)
            if not kind or (words and kind[0] != "mixed"):
                continue
            if -sum(n / 20 * math.log2(n / 20) for n in Counter(window).values()) >= kind[1] - 1e-9:
                if spans and spans[-1][1] >= start:
                    spans[-1][1] = start + 20
                else:
                    spans.append([start, start + 20])
        for a, b in ((run.start() + a, run.start() + b) for a, b in spans):
            if not any(s < b and a < e for s, e in taken):
                found.append((a, 3, "entropy", b))
    return ",".join(f"{kind}:{start}:{end}" for start, _, kind, end in sorted(found))


def quality_base(text):
    text = text or ""
    found = WORD.findall(text)
    triples = list(zip(found, found[1:], found[2:]))
    times, covered = Counter(triples), set()
    for i, triple in enumerate(triples):
        if times[triple] > 1:
            covered |= {i, i + 1, i + 2}
    seen, again = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    failed = len(found) < 50 or 100 * len(covered) > 50 * len(found)
    return (len(found), sum(map(len, found)), sum(c in "#*$%&|<>" for c in text), again,
            len(covered), failed)


def shingles(text):
    found = lower_words(text)
    if len(found) < 5:
        return {tuple(found)} if found else set()
    return set(zip(*(found[i:] for i in range(5))))


def components(texts):
    """``{id: (set size, component)}`` of ``{id: text}`` by comparing all pairs."""
    sets = {i: shingles(t) for i, t in texts.items()}
    ids, name = sorted(sets), {i: i for i in sets}

    def root(i):
        while name[i] != i:
            i = name[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[n + 1:]:
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                name[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in ids}


def language_model(rows, strength):
    """``(held out, tokens, known, training tokens, base, score)`` for ``(id, text)`` rows."""
    texts = [(remainder(i) == 1, [*lower_words(t), None]) for i, t in rows]
    single, pair = Counter(), Counter()
    for held, tokens in texts:
        if not held:
            single.update(tokens)
            pair.update(zip([None, *tokens], tokens))
    total, known = sum(single.values()), len(single)

    def base(token):
        return (single[token] + 0.5) / (total + 0.5 * (known + 1))

    found = []
    for held, tokens in texts:
        steps = [math.log10((pair[h, t] + strength * base(t)) / (single[h] + strength))
                 for h, t in zip([None, *tokens], tokens)]
        found.append((held, len(tokens), sum(single[t] > 0 for t in tokens), total,
                      sum(math.log10(base(t)) for t in tokens), sum(steps)))
    return found


def sha256(text):
    return hashlib.sha256(text.encode()).hexdigest()
