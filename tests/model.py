"""A plain model of region building and scoring for upright boxes, one request at a time, to hold the Spark plan against."""

import re
from fractions import Fraction
from math import gcd, hypot

from boxsift.rules import RuleSet

R = RuleSet()
PHONE = re.compile(R.phone_pattern.removeprefix("(?U)"))
WECHAT = re.compile(R.wechat_pattern.removeprefix("(?iU)"), re.I)
QQ = re.compile(R.qq_pattern.removeprefix("(?iU)"), re.I)
EXTRA_NOISE = ("刻章", "办证", "贷款", "发票")


def words_in(text, words, aliases):
    return {w for w in words if w in text} | {c for c, a in aliases.items() if any(x in text for x in (c, *a))}


def phones_in(text):
    found = (re.sub(r"\D", "", x) for x in PHONE.findall(text))
    return sorted({x for x in found if len(x) == 11 and x[0] == "1"})


class Box:
    def __init__(self, i, text, x1, y1, x2, y2):
        self.i, self.text, self.b = i, text, (x1, y1, x2, y2)
        self.c = ((x1 + x2) / 2, (y1 + y2) / 2)
        self.med = words_in(text, R.medical_keywords, R.medical_aliases)
        self.ill = words_in(text, R.illegal_keywords, R.illegal_aliases)
        self.phones, self.wechat, self.qq = phones_in(text), sorted(set(WECHAT.findall(text))), sorted(set(QQ.findall(text)))
        self.noise = any(w in text for w in (*R.noise_keywords, *EXTRA_NOISE))
        self.key, self.contact = bool(self.med or self.ill), bool(self.phones or self.wechat or self.qq)
        self.like = self.contact or any(w in text for w in R.contact_keywords) or bool(re.search(r"\d{6,}", text))

    def far(self, o):
        return hypot(self.c[0] - o.c[0], self.c[1] - o.c[1])


def frame(boxes):
    return tuple(f(b.b[k] for b in boxes) for k, f in enumerate((min, min, max, max)))


def around(boxes):
    """The frame of the grown smallest rectangle around upright boxes: every direction of two corners is tried."""
    ps = sorted({(b[i], b[j]) for b in boxes for i in (0, 2) for j in (1, 3)})
    best = None
    for p in ps:
        for q in ps:
            dx, dy = (q[0] - p[0], q[1] - p[1]) if p != q else (1, 0)
            for _ in range(4):
                if dx > 0 and -dx < dy <= dx:
                    break
                dx, dy = -dy, dx
            g = gcd(dx, dy)
            dx, dy = dx // g, dy // g
            a, b = [x * dx + y * dy for x, y in ps], [y * dx - x * dy for x, y in ps]
            n = dx * dx + dy * dy
            got = (Fraction((max(a) - min(a)) * (max(b) - min(b)), n), abs(Fraction(dy, dx)), Fraction(dy, dx), dx, dy, min(a), max(a), min(b), max(b), n)
            best = got if best is None or got < best else best
    _, _, _, dx, dy, a1, a2, b1, b2, n = best
    r, x, y = n**0.5, (a1 + a2) / 2 / n, (b1 + b2) / 2 / n
    x, y = dx * x - dy * y, dy * x + dx * y
    w, h = max((a2 - a1) / r, 24) * 1.55 / 2, max((b2 - b1) / r, 24) * 1.8 / 2
    points = [(max(0, round(x + s * w * dx / r - t * h * dy / r)), max(0, round(y + s * w * dy / r + t * h * dx / r))) for s, t in ((-1, -1), (1, -1), (1, 1), (-1, 1))]
    return tuple(f(p[k] for p in points) for f, k in ((min, 0), (min, 1), (max, 0), (max, 1)))


def iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if w <= 0 or h <= 0:
        return 0.0
    area = lambda r: max(1, (r[2] - r[0]) * (r[3] - r[1]))
    return w * h / (area(a) + area(b) - w * h)


def alike(a, b):
    return len(set(a) & set(b)) >= max(1, min(len(a), len(b)) // 2)


def regions(boxes):
    used, kept = set(), []
    for a in boxes:
        if not (a.key or a.contact) or a.i in used:
            continue
        w, h = max(20, a.b[2] - a.b[0]), max(20, a.b[3] - a.b[1])
        lx, ly = max(70, int(w * 2.2)), max(120, int(h * 5.0))
        inside = [a] + [o for o in boxes if o is not a and not (o.noise and not o.key and not o.contact) and abs(o.c[0] - a.c[0]) <= lx and abs(o.c[1] - a.c[1]) <= ly]
        f = frame(inside)
        px, py = max(12, int((f[2] - f[0]) * 0.18)), max(12, int((f[3] - f[1]) * 0.2))
        f, ids = (f[0] - px, f[1] - py, f[2] + px, f[3] + py), [o.i for o in inside]
        if not any(iou(g, f) >= 0.35 or alike(j, ids) for g, j, _ in kept):
            kept.append((f, ids, inside))
        used.update(ids)
    return kept


def contacts(items, boxes):
    """Scores of the contacts of a region: index to score."""
    keys = [b for b in items if b.key]
    cores = keys + [b for b in items if not b.key and not b.noise and not b.contact and any(b.far(k) <= 90 for k in keys)] if keys else []
    out = {}
    for c in items:
        if not cores or not c.like:
            continue
        f = frame(cores)
        diag = max(1.0, hypot(f[2] - f[0], f[3] - f[1]))
        near = min(c.far(k) for k in cores)
        mx, my = (sum(k.c[j] for k in cores) / len(cores) for j in (0, 1))
        low = c.c[1] >= my - 20 and abs(c.c[0] - mx) <= max(60.0, diag * 0.4)
        noisy = c.noise or any(b.noise and b is not c and c.far(b) <= 85 for b in boxes)
        s = 0.24 + 0.12 + max(0.0, 1 - min(1.0, near / diag)) * 0.2 + (1.0 if near <= 80 else 0.35) * 0.16 + (0.8 if low else 0.4) * 0.16 - (0.35 if noisy else 0)
        out[c.i] = max(0.0, min(1.0, s))
    return out


def score(items, boxes):
    at = contacts(items, boxes)
    best = lambda kind: next(iter(sorted(((-round(at[b.i], 4), k, getattr(b, kind)) for k, b in enumerate(items) if b.i in at and round(at[b.i], 4) >= 0.55 and getattr(b, kind)))), (0, 0, []))[2]
    read = sorted(range(len(items)), key=lambda k: (items[k].c[1], items[k].b[0], k))
    text = "".join(items[k].text.strip() for k in read)
    single = {b.text.strip() for b in items}
    med = words_in(text, R.medical_keywords, R.medical_aliases).union(*(b.med for b in items))
    ill = words_in(text, R.illegal_keywords, R.illegal_aliases).union(*(b.ill for b in items))
    ill |= {w for w in ("取现", "提现") if set(w) <= single}
    phones, wechat, qq = sorted({*best("phones"), *phones_in(text)}), best("wechat"), best("qq")
    some = bool(phones or wechat or qq)
    total = (min(35, 12 + 6 * len(med)) if med else 0) + (min(40, 15 + 8 * len(ill)) if ill else 0) + 24 * bool(phones) + 18 * bool(wechat) + 16 * bool(qq)
    total += 20 * (bool(med) and some) + 12 * (bool(med) and bool(ill)) + 10 * (len(ill) >= 2)
    return min(100, max(total, 45) if med else total), med, ill, phones, wechat, qq, {i for i, s in at.items() if round(s, 4) >= 0.55}


def ads(boxes):
    kept = []
    for _, _, items in regions(boxes):
        total, med, ill, phones, wechat, qq, attached = score(items, boxes)
        if not (med or ill or phones or wechat or qq or total):
            continue
        own = [b for b in items if not b.like or b.i in attached] or items
        f = frame(own)
        px, py = (max(40, int(max(40, f[k + 2] - f[k]) * 0.35)) for k in (0, 1))
        g = (f[0] - px, f[1] - py, f[2] + px, f[3] + py)
        meets = lambda b: not (g[2] < b.b[0] or g[0] > b.b[2] or g[3] < b.b[1] or g[1] > b.b[3])
        own = own + [b for b in boxes if b.key and b not in own and meets(b)]
        f = around([b.b for b in own])
        ad = {"n": len(kept) + 1, "f": f, "ids": [b.i for b in own], "score": total, "bad": total >= 45 or bool(med and ill)}
        k = next((k for k, o in enumerate(kept) if iou(o["f"], f) >= 0.45 or alike(o["ids"], ad["ids"])), None)
        if k is not None:
            if kept[k]["score"] >= total:
                continue
            kept.pop(k)
        kept.append(ad)
    return kept
