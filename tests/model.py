"""A plain sequential model of the cascade for small batches, written from its rules; used by tests only."""

from itertools import combinations, product

from ledgerweave.config import ReconcileConfig


class Model:
    def __init__(self, rows, lines, config=ReconcileConfig()):
        """rows: dicts row_id, day, net, sid, utr in file order. lines: dicts txn_id, day, credit, debit, text, utrs in statement order."""
        self.rows, self.lines, self.c = rows, lines, config
        self.free = {r["row_id"]: r for r in rows}
        self.out, self.declined = {}, set()

    def batch(self, sid):
        mine = [r for r in self.rows if r["sid"] == sid]
        return mine[0]["day"], [r for r in mine if r["row_id"] in self.free]

    def named(self, line):
        for u in line["utrs"]:
            for sid in sorted({r["sid"] for r in self.rows if r["sid"] and r["utr"] == u}):
                day, left = self.batch(sid)
                if left and abs(line["day"] - day) <= self.c.date_window_days:
                    yield line["day"] - day, left

    def exact(self, line):
        return [(left, 0, lag) for lag, left in self.named(line) if sum(r["net"] for r in left) == line["credit"]]

    def fuzzy(self, line):
        for sid in dict.fromkeys(r["sid"] for r in self.rows if r["sid"]):
            day, left = self.batch(sid)
            delta = line["credit"] - sum(r["net"] for r in left)
            if left and abs(line["day"] - day) <= self.c.date_window_days and abs(delta) <= self.c.amount_tolerance_paise:
                yield left, delta, line["day"] - day

    def unsafe(self, n, total):
        return n > self.c.subset_safe_rows or min(1, 2**n / max(total, 1)) > self.c.max_collision_risk

    def sets(self, pool, target):
        pool = [r for r in pool if r["net"]]
        hits = (tuple(r for r, k in zip(pool, m) if k) for m in product((0, 1), repeat=len(pool)))
        return [h for h in hits if target > 0 and h and sum(r["net"] for r in h) == target][:2]

    def arithmetic(self, line):
        found, target = [], line["credit"]
        for lag, left in self.named(line):
            total, n = sum(r["net"] for r in left), len(left)
            if n < 2 or total < target:
                continue
            order = sorted(left, key=lambda r: r["row_id"])
            cuts = [order] if total == target else [order[:k] for k in range(1, n + 1)] + [order[-k:] for k in range(1, n + 1)]
            hit = next((p for p in cuts if sum(r["net"] for r in p) == target), None)
            if hit:
                found.append((hit, 0, lag))
            elif self.unsafe(n, total):
                self.declined.add(line["txn_id"])
            else:
                found += [(h, 0, lag) for h in self.sets(order, target)]
        if found:
            return found
        days = {}
        for r in self.rows:
            if not r["sid"] and r["row_id"] in self.free and abs(line["day"] - r["day"]) <= self.c.date_window_days:
                days.setdefault(r["day"], []).append(r)
        for k in range(1, 5):
            for some in combinations(sorted(days), k):
                if sum(r["net"] for d in some for r in days[d]) == target:
                    found.append(([r for d in some for r in days[d]], 0, line["day"] - max(some)))
        if found:
            return found
        for d in sorted(days, key=lambda d: (abs(line["day"] - d), d)):
            pool, n = days[d], len(days[d])
            total, lag = sum(r["net"] for r in pool), line["day"] - d
            risk = min(1, (1 + n + n * (n - 1) // 2 + n * (n - 1) * (n - 2) // 6) / max(total, 1))
            drop = self.drop(pool, total - target)
            if drop is not None and len(drop) < n and risk <= self.c.max_collision_risk:
                return [([r for i, r in enumerate(pool) if i not in drop], 0, lag)]
            if self.unsafe(n, total):
                self.declined.add(line["txn_id"])
                continue
            found = [(h, 0, lag) for h in self.sets(pool, target)]
            if found:
                return found
        return []

    @staticmethod
    def drop(pool, gap):
        if gap < 0:
            return None
        a = [r["net"] for r in pool]
        ways = [(i,) for i, x in enumerate(a) if x == gap][:1]
        ways = ways or sorted(((i, j) for i, j in combinations(range(len(a)), 2) if a[i] + a[j] == gap), key=lambda p: (p[1], -p[0]))[:1]
        ways = ways or [t for t in combinations(range(len(a)), 3) if sum(a[i] for i in t) == gap][:1]
        return ways[0] if ways else (() if gap == 0 else None)

    def take(self, line, tier, rows, delta, confidence):
        self.out[line["txn_id"]] = (tier, tuple(sorted(r["row_id"] for r in rows)), delta, confidence, None)
        for r in rows:
            del self.free[r["row_id"]]

    def run(self):
        for line in self.lines:
            if line["credit"] <= 0:
                self.out[line["txn_id"]] = ("tier5_exception", (), 0, 0.0, "chargeback_debit")
        moved = True
        while moved:
            moved, pending = False, {}
            for tier, find, sure in (("tier1_exact", self.exact, 0.99), ("tier2_fuzzy", self.fuzzy, 0.9), ("tier3_subset_sum", self.arithmetic, 0.85)):
                for line in self.lines:
                    if line["txn_id"] in self.out:
                        continue
                    found = list(find(line))
                    if len(found) == 1:
                        self.take(line, tier, found[0][0], found[0][1], sure)
                        moved = True
                    else:
                        pending.setdefault(line["txn_id"], []).extend(found)
        for line in self.lines:
            left = [c for c in pending.get(line["txn_id"], []) if all(r["row_id"] in self.free for r in c[0])]
            if line["txn_id"] in self.out or not left or not self.c.adjudicate:
                continue
            left.sort(key=lambda c: (abs(c[1]), abs(c[2]), -len(c[0])))
            cost = [abs(c[1]) + 100 * abs(c[2]) for c in left]
            if len(left) == 1 or (cost[1] > 0 and cost[0] < 0.75 * cost[1]):
                self.take(line, "tier4_adjudicated", left[0][0], left[0][1], 0.8 if len(left) == 1 else 0.72)
        for line in self.lines:
            if line["txn_id"] not in self.out:
                kind = "ambiguous_candidates" if pending.get(line["txn_id"]) else "orphan_credit" if "RZP" not in line["text"] else "arithmetic_unsafe" if line["txn_id"] in self.declined else "no_candidate" if self.free else "missing_in_bank"
                self.out[line["txn_id"]] = ("tier5_exception", (), 0, 0.0, kind)
        return self.out
