"""Plain versions of the corpus operators, one value after the other, to hold the operators against."""

import collections
import datetime as dt
import hashlib
import math
import re
from fractions import Fraction

import regex
import xxhash

from ledgerlight.llm import pii, quality


def draw(key, kind, n, r, value, below):
    return int(hashlib.sha256(f"{key}|{kind}|{n}|{r}|{value}".encode()).hexdigest()[:15], 16) % below


def feistel(key, kind, n, left, right, left_size, right_size):
    for i in range(1, 9):
        if i % 2:
            left = (left + draw(key, kind, n, i, right, left_size)) % left_size
        else:
            right = (right + draw(key, kind, n, i, left, right_size)) % right_size
    return left, right


def digits(key, kind, text):
    n = len(text)
    a = n // 2
    left, right = feistel(key, kind, n, int(text[:a]), int(text[a:]), 10**a, 10 ** (n - a))
    return f"{left:0{a}d}{right:0{n - a}d}"


def filled(form, text):
    turn = iter(text)
    return "".join(next(turn) if c in "0123456789" else c for c in form)


def luhn(text):
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(text)))


def modulo(text):
    return int("".join(str(int(c, 36)) for c in text)) % 97


def card(key, m):
    d = re.sub("[^0-9]", "", m)
    if luhn(d) % 10:
        return None
    payload = digits(key, "card", d[:-1])
    return filled(m, payload + str(-luhn(payload + "0") % 10))


def iban(key, m):
    plain = m.replace(" ", "")
    if modulo(plain[4:] + plain[:4]) != 1 or len(plain) < 15:
        return None
    body = plain[4:]
    numbers = re.sub("[^0-9]", "", body)
    changed = filled(body, digits(key, "iban", numbers) if len(numbers) > 1 else numbers)
    return filled(m, re.sub("[^0-9]", "", f"{98 - modulo(changed + plain[:2] + '00'):02d}" + changed))


def ssn(key, m):
    area, group, serial = map(int, m.split("-"))
    if not 0 < area < 900 or area == 666 or not group or not serial:
        return None
    left, right = feistel(key, "ssn", 9, (area - 1 - (area > 666)) * 99 + group - 1, serial - 1, 898 * 99, 9999)
    area = left // 99 + 1
    return f"{area + (area >= 666):03d}-{left % 99 + 1:02d}-{right + 1:04d}"


def address(key, m):
    a, b, c, d = map(int, m.split("."))
    left, right = feistel(key, "address", 4, a * 256 + b, c * 256 + d, 65536, 65536)
    return f"{left // 256}.{left % 256}.{right // 256}.{right % 256}"


FIRST = dt.date(1900, 1, 1).toordinal()
DAYS = dt.date(2100, 1, 1).toordinal() - FIRST


def moved(key, day):
    n = day.toordinal()
    if FIRST <= n < FIRST + DAYS:
        left, right = feistel(key, "date", 0, *divmod(n - FIRST, 4297), 17, 4297)
        return dt.date.fromordinal(FIRST + left * 4297 + right)
    index = n - 1 if n < FIRST else n - 1 - DAYS
    left, right = feistel(key, "date", 1, *divmod(index, 21053), 170, 21053)
    out = left * 21053 + right
    return dt.date.fromordinal(out + 1 if out < FIRST - 1 else out + 1 + DAYS)


#: Separator, which parts are year, month and day, and the form to write them in.
FORMS = [("-", (0, 1, 2), "{0:04d}-{1:02d}-{2:02d}"), ("/", (2, 0, 1), "{1:02d}/{2:02d}/{0:04d}"), (".", (2, 1, 0), "{2:02d}.{1:02d}.{0:04d}"), ("/", (2, 1, 0), "{2:02d}/{1:02d}/{0:04d}")]


def date(key, m):
    for separator, parts, form in FORMS:
        if separator not in m:
            continue
        found = [int(x) for x in m.split(separator)]
        try:
            day = moved(key, dt.date(*(found[k] for k in parts)))
        except ValueError:
            continue
        while form.startswith("{2:02d}/") and day.day <= 12:
            day = moved(key, day)
        return form.format(day.year, day.month, day.day)
    return None


def phone(key, m):
    prefix = re.match(r"(?:\+[0-9]{1,3}(?=[ .(-])[ .-]?)?", m)[0]
    rest = m[len(prefix) :]
    return prefix + filled(rest, digits(key, "phone", re.sub("[^0-9]", "", rest)))


def email(key, m):
    name, host = m.split("@")
    sha = lambda what: hashlib.sha256(f"{key}|email|{what}".encode()).hexdigest()
    return f"u{sha(name + '@' + host.lower())[:16]}@h{sha(host.lower())[:10]}.invalid"


def secret(key, m):
    out = "".join(hashlib.sha256(f"{key}|{kind}|{m}".encode()).hexdigest() for kind in ("secret", "secret more"))[: len(m)]
    return out.upper() if m == m.upper() else out


MAKERS = {"email": email, "secret": secret, "iban": iban, "address": address, "date": date, "ssn": ssn, "phone": phone, "card": card}


def is_kind(kind, x):
    return re.fullmatch(pii.KINDS[kind], x) is not None


def parted(m):
    """The candidate in the parts that count for themselves."""
    good_card = lambda x: bool(re.match(pii.GROUPS, x)) and is_kind("card", x) and card("", x) is not None
    good_iban = lambda x: is_kind("iban", x) and iban("", x) is not None
    gaps = [k for k, c in enumerate(m) if c in " -"]
    if is_kind("iban", m):
        heads = [k for k in gaps if good_iban(m[:k])]
        return m if iban("", m) is not None or not heads else m[: heads[-1]] + pii.MARK + m[heads[-1] :]
    if is_kind("card", m) and card("", m) is None:
        heads, tails = [k for k in gaps if good_card(m[:k])], [k for k in gaps if good_card(m[k + 1 :])]
        if heads:
            return m[: heads[-1]] + pii.MARK + m[heads[-1] :]
        if tails:
            return m[: tails[0] + 1] + pii.MARK + m[tails[0] + 1 :]
    return m


def pseudonymised(text, key=pii.KEY):
    """The text under pseudonyms and the number of replacements."""
    if text is None:
        return None, 0
    for _ in range(pii.PARTINGS):
        if re.search(pii.LONG, text):
            text = re.sub(pii.ANY, lambda m: parted(m[0]), text)
    changed = 0

    def replaced(m):
        nonlocal changed
        new = next((x for kind, make in MAKERS.items() if is_kind(kind, m[0]) and (x := make(key, m[0])) is not None), m[0])
        changed += new != m[0]
        return new

    return re.sub(pii.ANY, replaced, text).replace(pii.MARK, ""), changed


FULL = (1 << 64) - 1


def scrambled(x, k=0):
    x = (x + 0x9E3779B97F4A7C15 * (k + 1)) * 0xBF58476D1CE4E5B9 & FULL
    x ^= x >> 29
    x = x * 0x94D049BB133111EB & FULL
    return x ^ (x >> 32)


class BloomScores:
    """The log-frequency filter as sets of bits, and the scores that are read from it, one token after the other."""

    END, START = xxhash.xxh64_intdigest(b" end"), xxhash.xxh64_intdigest(b" start")

    def __init__(self, training, n_docs):
        self.bits = max(1, (n_docs // 1024).bit_length())
        self.words, pairs = collections.Counter(), collections.Counter()
        for text in training:
            run = self.run(text)
            self.words.update(run)
            pairs.update(self.pairs(run))
        self.total, self.types = sum(self.words.values()), len(self.words)
        grams = [(0, h, c) for h, c in self.words.items()] + [(1, h, c) for h, c in pairs.items()]
        level = lambda c: 1 + math.floor(math.log(c) / math.log(1.5) + 1e-9)
        entries = collections.Counter()
        for _, h, c in grams:
            entries[h >> 64 - self.bits] += level(c)
        self.size = {p: max(64, 10 * n) for p, n in entries.items()}
        self.filter = {(h >> 64 - self.bits, bit) for kind, h, c in grams for j in range(1, level(c) + 1) for bit in self.probes(kind, h, j)}

    def run(self, text):
        return [xxhash.xxh64_intdigest(w) for w in (text or "").encode().lower().split()] + [self.END]

    def pairs(self, run):
        return [scrambled(a * 0xD6E8FEB86659FD93 + b & FULL, 7) for a, b in zip([self.START, *run], run)]

    def probes(self, kind, h, j):
        item = scrambled(h ^ (0x5851F42D4C957F2D * (kind + 1) & FULL), 11) + scrambled(j, 13) & FULL
        step = scrambled(item, 3) | 1
        size = self.size[h >> 64 - self.bits]
        return [((item + i * step & FULL) >> 32) * size >> 32 for i in range(6)]

    def count(self, kind, h):
        """The middle of the range of counts that the highest level stands for whose bits are all set."""
        part, j = h >> 64 - self.bits, 0
        while part in self.size and all((part, bit) in self.filter for bit in self.probes(kind, h, j + 1)):
            j += 1
        return j and (math.ceil(1.5 ** (j - 1) - 1e-9) + math.ceil(1.5**j - 1e-9) - 1) / 2

    def score(self, text):
        """Tokens, known tokens, base score and score."""
        run, below = self.run(text), self.total + 0.1 * (self.types + 1)
        base = sum(math.log10((self.words[h] + 0.1) / below) for h in run)
        score, context = 0.0, self.count(0, self.END)
        for h, pair in zip(run, self.pairs(run)):
            own = self.count(0, h)
            score += math.log10((min(self.count(1, pair), context) + 20 * (own + 0.1) / below) / (context + 20))
            context = own
        return len(run), sum(self.words[h] > 0 for h in run), base, score


def letter_grams(text):
    """Buckets and counts of the n-grams of 1 to 3 letters."""
    plain = " ".join("".join(c if c.isalpha() else " " for c in (text or "").lower()).split())
    out = collections.Counter()
    if plain:
        plain = f" {plain} "
        for n in (1, 2, 3):
            for k in range(len(plain) - n + 1):
                x = n
                for c in plain[k : k + n]:
                    x = (x ^ ord(c)) * 0x9E3779B97F4A7C15 & FULL
                    x ^= x >> 29
                out[x % (1 << 14)] += 1
    return out


class Languages:
    """The softmax regression by FTRL-proximal, one weight after the other, on ``training`` (text, language) without a bound."""

    def __init__(self, training):
        held = collections.Counter()
        texts = 0
        for text, _ in training:
            grams = letter_grams(text)
            held.update(grams.keys())
            texts += bool(grams)
        self.idf = lambda b: math.log((1 + texts) / (1 + held[b])) + 1
        self.names = sorted({lang for _, lang in training})
        signed = lambda t: (h := xxhash.xxh64_intdigest(t.encode(), 42)) - (h >> 63 << 64)
        order = sorted({(signed(t), lang, t) for t, lang in training})
        known = [(x, self.names.index(lang)) for _, lang, t in order if (x := self.features(t))]
        self.z, self.n = collections.defaultdict(float), collections.defaultdict(float)
        for _ in range(6):
            for k, (x, label) in enumerate(known):
                if k % 5 or len(known) < 10:
                    self.learn(x, label)
        calibration = [(self.logits(x), label) for k, (x, label) in enumerate(known) if k % 5 == 0]
        low, high = -4.0, 3.0
        ratio = (5**0.5 - 1) / 2
        loss = lambda q: sum(math.log(sum(math.exp(v / math.exp(q)) for v in z)) - z[y] / math.exp(q) for z, y in calibration)
        for _ in range(40 if calibration else 0):
            a, b = high - ratio * (high - low), low + ratio * (high - low)
            low, high = (low, b) if loss(a) <= loss(b) else (a, high)
        self.heat = math.exp((low + high) / 2) if calibration else 1.0

    def features(self, text):
        x = {b: (1 + math.log(n)) * self.idf(b) for b, n in letter_grams(text).items()}
        norm = math.sqrt(sum(v * v for v in x.values()))
        return {b: v / norm for b, v in x.items()}

    def weight(self, b, c):
        z = self.z[b, c]
        return 0.0 if abs(z) <= 1e-3 else -(z - math.copysign(1e-3, z)) / ((1 + math.sqrt(self.n[b, c])) / 0.8 + 1e-3)

    def logits(self, x):
        return [sum(v * self.weight(b, c) for b, v in x.items()) for c in range(len(self.names))]

    def chances(self, logits):
        e = [math.exp(v) for v in logits]
        return [v / sum(e) for v in e]

    def learn(self, x, label):
        p = self.chances(self.logits(x))
        for c in range(len(p)):
            for b, v in x.items():
                g, n = v * (p[c] - (c == label)), self.n[b, c]
                self.z[b, c] += g - (math.sqrt(n + g * g) - math.sqrt(n)) / 0.8 * self.weight(b, c)
                self.n[b, c] = n + g * g

    def predict(self, text):
        x = self.features(text)
        if not x or not self.names:
            return "und", 0.0
        p = self.chances([v / self.heat for v in self.logits(x)])
        return self.names[p.index(max(p))], max(p)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def hashed(*values, seed=42):
    """Spark's hash of a row of long integers: each seeds the next; nulls are skipped."""
    for v in values:
        seed = seed if v is None else xxhash.xxh64_intdigest((v & FULL).to_bytes(8, "little"), seed)
    return signed(seed)


def words_of(text):
    return [w for w in re.split("[ \t\n\x0b\x0c\r]+", text or "") if w]


def quality_kept(texts, trusted):
    """Which texts the quality rules keep; ``trusted`` tells which are trusted."""
    runs = []
    for t in texts:
        h = [signed(xxhash.xxh64_intdigest(w, 42)) for w in regex.findall(quality.TOKENS, t or "")]
        runs.append([x % 8192 for x in h] + [hashed(a, b) % 8192 for a, b in zip(h, h[1:])])
    raw, good = collections.Counter(g for r in runs for g in r), collections.Counter(g for r, y in zip(runs, trusted) if y for g in r)
    n, m = sum(raw.values()), sum(good.values())

    def weight(g):
        p = (raw[g] + 1) / (n + 8192)
        return math.log((good[g] + 2000 * p) / (m + 2000) / p) if m else 0.0

    out = []
    for t, r in zip(texts, runs):
        words = words_of(t)
        windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
        many = collections.Counter(windows)
        again = {k + j for k, w in enumerate(windows) if many[w] > 1 for j in range(8)}
        out.append(len(words) >= 20 and 100 * len(again) <= 30 * len(words) and (sum(map(weight, r)) / len(r) if r else 0.0) >= -0.2)
    return out


def near_copies(rows):
    """The (id, text) rows that stay: the first of each component of texts whose five-word shingles are similar by 0.8."""
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, signed(xxhash.xxh64_intdigest((r[1] or "").encode(), 42))))
    shingles = []
    for _, t in order:
        w = (t or "").encode().lower().split()
        shingles.append({b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    label = list(range(len(order)))
    for a in range(len(order)):
        for b in range(a):
            both = len(shingles[a] & shingles[b])
            if both and both >= 0.8 * len(shingles[a] | shingles[b]) and label[a] != label[b]:
                low, high = sorted((label[a], label[b]))
                label = [low if x == high else x for x in label]
    return [r for k, r in enumerate(order) if label[k] == k]


def holds(text, item):
    """Whether greedy tiles of five tokens and more cover half of the item."""
    tokens = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    item, text = tokens(item), tokens(text)
    least, free_p, free_t, covered = min(5, len(item)), [True] * len(item), [True] * len(text), 0
    while item:
        best = None
        for p in range(len(item)):
            for t in range(len(text)):
                n = 0
                while p + n < len(item) and t + n < len(text) and free_p[p + n] and free_t[t + n] and item[p + n] == text[t + n]:
                    n += 1
                if n >= least and (best is None or n > best[0]):
                    best = (n, p, t)
        if best is None:
            break
        n, p, t = best
        free_p[p : p + n] = free_t[t : t + n] = [False] * n
        covered += n
    return bool(item) and covered >= 0.5 * len(item)


def targets(sizes):
    """The words to take of each source, from ``sizes`` (source to words)."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {n: (1, 2, 3)[k % 3] for k, n in enumerate(names)}
    target, free, rest = {}, set(names), Fraction(sum(sizes.values()))
    while free:
        level = rest / sum(weight[n] for n in free)
        over = {n for n in free if weight[n] * level > 3 * sizes[n]}
        if not over:
            return {**target, **{n: float(weight[n] * level) for n in free}}
        for n in over:
            target[n] = float(3 * sizes[n])
            rest -= 3 * sizes[n]
        free -= over
    return target


def mixed(rows):
    """``rows`` (id, text, source) to the words taken of each: up to three passes over a source in hashed order."""
    sized = [(i, len(words_of(t)), s) for i, t, s in rows]
    total = collections.Counter()
    for _, n, s in sized:
        total[s] += n
    want, taken = targets(dict(total)), {}
    for source, words in want.items():
        at = 0
        seed = xxhash.xxh64_intdigest((42).to_bytes(4, "little"), 42)
        for i, n in sorted(((i, n) for i, n, s in sized if s == source), key=lambda x: (hashed(*x, seed=seed) & FULL, x)):
            taken[i] = sum(max(0, min(int(words), k * total[source] + at + n) - (k * total[source] + at)) for k in range(3))
            at += n
    return taken
