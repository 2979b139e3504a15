"""The organization job against a plain version of it, record by record, and its parts on literal rows."""

import random
import re
from difflib import SequenceMatcher
from urllib.parse import unquote, urlsplit

import pytest

from vouch import constants as K
from vouch.operators import contacts as C
from vouch.operators import orgs as O
from vouch.operators.parse import parsed
from vouch.plans import organizations as J

NOTES = J.NOTES


def words(s):
    return " ".join(re.findall(r"\w+", (s or "").casefold()))


def says(text, phrase):
    return bool(words(phrase)) and f" {words(phrase)} " in f" {words(text)} "


def host(url):
    return urlsplit(url).hostname or ""


def within(name, domain):
    return name == domain or name.endswith("." + domain)


def named(name, texts):
    """Whether texts together name an organization."""
    tokens = list(dict.fromkeys(t for t in re.findall("[a-z0-9]+(?:-op)?", re.sub(r"\([^)]*\)", "", name.casefold())) if t not in K.NAME_STOP_WORDS))
    folded = [t.casefold() for t in texts]
    missing = [t for t in tokens if not any(re.search(rf"\b{re.escape(t)}\b", x) for x in folded)]
    if any(says(t, name) for t in texts) or (tokens and not missing):
        return True
    near = lambda w: len(missing[0]) >= 4 and w[0] == missing[0][0] and abs(len(w) - len(missing[0])) < 2 and SequenceMatcher(None, missing[0], w).ratio() >= 0.75
    return len(tokens) > 2 and len(missing) == 1 and any(near(w) for x in folded for w in re.findall("[a-z0-9]+", x))


def placed(state, texts):
    full = K.STATES.get(state)
    return full is None or any(says(t, full) or re.search(rf"\b{state}\s+\d{{5}}(?:-\d{{4}})?\b", t) for t in texts)


def same(found, wanted):
    parts = [w for w in re.findall("[a-z]+", wanted.casefold()) if len(w) > 1]
    return bool(parts) and set(parts) <= set(re.findall("[a-z]+", found.casefold()))


def score(url, name):
    path = urlsplit(url).path.lower()
    return 15 * sum(w in path for w in re.findall("[a-z]+", name.lower()) if len(w) > 2) + 5 * sum(h in path for h in K.PATH_HINTS) - path.count("/")


def personal(url, name):
    path = unquote(urlsplit(url).path).casefold()
    return sum(w in path for w in re.findall("[a-z]+", name.casefold()) if len(w) > 2) + (path.endswith(".pdf") or "cv" in re.split("[^a-z]+", path))


class Plain:
    def __init__(self, t):
        get = lambda df, *order: df.toPandas().sort_values(list(order)).to_dict("records")
        self.requests = get(t.requests, "record_id")
        self.pages = get(t.pages, "page_id")
        self.by_url = {p["url"]: p for p in self.pages}
        self.candidates, self.listings = get(t.candidates, "record_id", "pos"), get(t.listings, "record_id", "hit")
        self.documents, self.named, self.company = get(t.documents, "domain", "pos"), get(t.named, "record_id", "pos"), get(t.company, "record_id", "pos")

    def site(self, domain, name, most):
        own = [p for p in self.pages if within(host(p["url"]), domain) and p["url"].startswith("https://")]
        return sorted(own, key=lambda p: (urlsplit(p["url"]).path not in ("", "/"), -score(p["url"], name), p["page_id"]))[:most]

    def contacts(self, pages, name):
        return [r for p in pages for r in C.contacts_of(p["html"], p["text"], p["url"], name)]

    def lookup(self, record, name, domain, notes):
        rows = self.contacts([p for p in self.site(domain, name, 6) if says(p["text"], name)], name)
        if not any(same(r["name"], name) for r in rows):
            urls = list(dict.fromkeys(x["url"] for x in self.named if x["record_id"] == record and x["contact_name"] == name))
            own = sorted((u for u in urls if within(host(u), domain)), key=lambda u: -personal(u, name))[:4]
            for u in own + [u for u in urls if not within(host(u), domain)][:3]:
                page, mine = self.by_url.get(u), within(host(u), domain)
                if page is None or not says(page["text"], name):
                    continue
                for r in self.contacts([page], name):
                    if within(r["email"].split("@")[1], domain) and (mine or (same(r["name"], name) and C.fits_local(r["email"], name))):
                        if not mine:
                            r |= {"email_evidence": "listed_on_public_third_party_page", "background": f"Listed on {host(u)}: {r['background'][:900]}"}
                        rows.append(r)
        if not any(same(r["name"], name) for r in rows):
            notes.append(NOTES["unnamed"].format(name))
        return rows

    def wide(self, record, name, domain, notes):
        urls = list(dict.fromkeys(x["url"] for x in self.company if x["record_id"] == record))
        hints = lambda u: -sum(h in urlsplit(u).path.lower() for h in ("staff", "contact", "directory", "personnel", "leadership", "team", "email"))
        own, away = sorted((u for u in urls if within(host(u), domain)), key=hints), sorted((u for u in urls if not within(host(u), domain)), key=hints)
        rows = []
        for u in (own[:4] + away[:4] + own[4:] + away[4:])[:8]:
            mine = within(host(u), domain)
            for r in self.contacts([self.by_url[u]] if u in self.by_url else [], name):
                if within(r["email"].split("@")[1], domain) and r["name"] and r["kind"] == "person" and r["relevance_score"] >= 50 and (not name or same(r["name"], name)) and (mine or C.fits_local(r["email"], r["name"])):
                    rows.append(r | {"identity_status": "supported", "email_evidence": "public_company_directory" if mine else "listed_on_public_third_party_page",
                                     "background": f"Public professional listing on {host(u)}: {r['background'][:850]}"})
        if not rows:
            notes.append(NOTES["company"])
        return rows

    def run(self, q):
        record, org, state, person, notes, site, public = q["record_id"], q["organization_name"], q["state"], q["contact_name"], [], None, False
        hosts = {}
        for c in self.candidates:
            if c["record_id"] == record:
                hosts.setdefault(host(c["url"]).removeprefix("www."), c["url"])
        if not hosts:
            notes.append(NOTES["none"])
        for h, url in list(hosts.items())[:5]:
            pages = self.site(h, "", 12)
            if not pages:
                notes.append(NOTES["unread"].format(h))
                continue
            texts = [p["text"] for p in pages]
            rights = re.findall(r"(?i)(?:copyright|©)\s*.{0,200}", texts[0])
            if not named(org, texts):
                notes.append(NOTES["name"].format(h))
            elif not named(org, [" ".join([" ".join(pages[0]["branding"]), " ".join(rights)])]):
                notes.append(NOTES["owner"].format(h))
            elif (ok := placed(state, texts)) or not site:
                site = (url, h, "supported" if ok else "unknown", pages)
                if ok:
                    break
        if not site:
            for x in [x for x in self.listings if x["record_id"] == record][:6]:
                for text, links in sorted(parsed(x["html"]).blocks, key=lambda b: len(b[0])):
                    away = {host(u).removeprefix("www.") for u in links if host(u) != host(x["source_url"])}
                    if named(org, [text]) and placed(state, [text]) and len(away) == 1 and "website" in text.lower():
                        site, public = (f"https://{min(away)}", min(away), "supported", [{"url": x["source_url"], "html": x["html"], "text": x["text"]}]), True
                        notes.append(NOTES["listed"])
                        break
        contacts, pages = [], []
        if site:
            domain, pages = site[1], site[3]
            contacts = self.contacts(pages, person)
            papers = [d for d in self.documents if d["domain"] == domain]
            rank = lambda d: 10 * sum(w in d["url"].lower() for w in re.findall("[a-z]+", person.lower()) if len(w) > 2) + 3 * sum(k in urlsplit(d["url"]).path.lower() for k in K.DOCUMENT_HINTS) - urlsplit(d["url"]).path.count("/")
            contacts += self.contacts([{**d, "html": ""} for d in sorted(papers, key=lambda d: (-rank(d), d["pos"]))[:3] if rank(d) > 0], person)
            if person and not any(same(r["name"], person) for r in contacts):
                contacts += self.lookup(record, person, domain, notes)
            elif not person and not any(r["name"] and r["identity_status"] == "supported" for r in contacts):
                best = {}
                for p in pages:
                    for name, role in O.leader_mentions(p["text"]):
                        entry = best.setdefault(name.lower(), [0, 0, name, role, p["url"]])
                        entry[1] += 1
                        if (value := C.relevance(role, False, "utility")) > entry[0]:
                            entry[0], entry[2:] = value, [name, role, p["url"]]
                for value, _, name, role, url in sorted((b for b in best.values() if b[0] >= 55), key=lambda b: (-b[0], -b[1]))[:2]:
                    found = self.lookup(record, name, domain, notes)
                    theirs = [r for r in found if same(r["name"], name)]
                    for r in theirs:
                        r |= {"title": r["title"] or role, "relevance_score": max(r["relevance_score"], value), "background": f"Named on {host(url)} as {role}. {r['background']}"}
                    contacts += found
                    if theirs:
                        break
            if not any(r["name"] and r["kind"] == "person" and r["identity_status"] == "supported" and r["relevance_score"] >= 50 and within(r["email"].split("@")[1], domain) and (not person or same(r["name"], person)) for r in contacts):
                contacts += self.wide(record, person, domain, notes)
            if site[2] == "unknown":
                notes.append(NOTES["state"])
        sources, kept = {}, {}
        for r in contacts:
            sources.setdefault(r["email"], set()).add(r["source_url"])
        for r in sorted(contacts, key=lambda r: (-r["relevance_score"], not r["name"])):
            kept.setdefault(r["email"], r)
        rows = []
        for r in list(kept.values())[:50]:
            off = not within(r["email"].split("@")[1], site[1])
            rows.append((record, r["email"], r["name"], r["title"], r["kind"], min(40, r["relevance_score"]) if off else r["relevance_score"], "review" if off else r["identity_status"],
                         r["email_evidence"], r["source_url"], len(sources[r["email"]]), r["background"]))
        facts = {}
        for field, pattern in O.FACTS.items():
            for p in pages:
                m = re.search(pattern, p["text"])
                if m and not (field == "customers_served" and (q["record_type"] == "association" or re.search(O.GUARD, p["text"][max(0, m.start() - 80) : m.start()]))):
                    facts[field] = m[1]
                    break
        utility = any(re.search(r"(?i)\b(?:utility|utilities|electric|water|natural gas|wastewater)\b", p["text"]) for p in pages)
        count = facts.get("customers_served", "").replace(",", "")
        if not site:
            scope = "Unknown"
        elif site[2] == "unknown" or not utility or (q["record_type"] != "association" and count and not 3000 <= int(count) <= 100000):
            scope = "Review"
        else:
            scope = "Yes"
        status = "needs_website" if not site else "completed" if site[2] == "supported" else "company_review"
        listed = "; ".join(sorted(f"{k}={v}" for k, v in facts.items())) or None
        return (record, status, site and site[0], site[2] if site else "unknown", scope, len(rows), listed, " | ".join(dict.fromkeys(notes))), rows


@pytest.fixture(scope="module")
def job(spark):
    t = J.tables(spark, "/root/testdata/sf0.01")
    return Plain(t), J.run(t)


def test_whole_job(spark, job, monkeypatch):
    plain, done = job
    want = [plain.run(q) for q in plain.requests]
    monkeypatch.setattr(J, "tables", lambda *_: None)
    monkeypatch.setattr(J, "run", lambda _: done)
    got = J.results(spark, "").drop("reason").collect()
    assert sorted(map(tuple, got), key=str) == sorted((w for w, _ in want), key=str)
    rows = J.contacts(spark, "").collect()
    assert sorted(map(tuple, rows), key=str) == sorted((r for _, c in want for r in c), key=str)
    # Every stage has done something, so that the comparison proves it.
    assert {w[1] for w, _ in want} == {"needs_website", "completed", "company_review"} and {w[4] for w, _ in want} == {"Unknown", "Review", "Yes"}
    for kind, text in NOTES.items():
        assert kind in ("unread", "name") or any(text.split("{")[0] in w[-1] for w, _ in want), kind
    assert {r[7] for _, c in want for r in c} >= {"publicly_listed", "listed_on_public_third_party_page", "public_company_directory"}
    assert any("Named on" in r[-1] for _, c in want for r in c)


def test_later_stages_see_open_records_only(job):
    _, done = job
    person = {r.record_id for r in done.sites.where("contact_name <> ''").collect()}
    led = {r.record_id for r in done.contacts.where("background like 'Named on %'").collect()}
    assert led and not led & person


def test_site_matches_puts_pages_together(spark):
    rows = [(1, "Cedar Valley Water District", "TX", t) for t in ("Cedar and more", "Valley Watr in Texas", "of the District")]
    rows += [(2, "Cedar Valley Water District", "TX", "Cedar Valley Pine District"), (3, "Pine Utilities", "", "Cedar Utilities"), (4, "Pine Utilities", "TX", "pine utilities")]
    df = spark.createDataFrame(rows, "record_id int, organization_name string, state string, text string")
    assert sorted(map(tuple, O.site_matches(df, ["record_id"]).collect())) == [(1, True, True), (2, False, False), (3, False, True), (4, True, False)]


def test_spelling_is_measured_in_its_own_order():
    rng = random.Random(5)
    for _ in range(100_000):
        token = "".join(rng.choice("abcd") for _ in range(rng.randint(4, 9)))
        word = "".join(rng.choice("abcd") for _ in range(len(token) + rng.randint(-1, 1))) if rng.random() < 0.5 else "".join(c for c in token if rng.random() < 0.9)
        assert O.close_spelling(token, [word]) == (SequenceMatcher(None, token, word).ratio() >= 0.75)


def test_near_words_and_matching(spark):
    df = spark.createDataFrame([("Guru Ghasi University", "The Guur Ghasi University of gurus guruji"), ("adcdbb second third", "abbdcbb second third"), ("abbdcbb second third", "adcdbb second third")], "n string, t string")
    got = [r.matches for r in O.organization_matches(df, "n", "t").collect()]
    assert got == [True, SequenceMatcher(None, "adcdbb", "abbdcbb").ratio() >= 0.75, SequenceMatcher(None, "abbdcbb", "adcdbb").ratio() >= 0.75]


def test_position_stated_near_a_name(spark):
    text = "Prof (Dr.) Ravi Anand Present Position: Head of Hydrology, ravi.k@uni.example +91 98765 43210 Email: verma.ravi@uni.example"
    df = spark.createDataFrame([(1, "https://www.uni.example/p", text, "Ravi Verma", "uni.example"), (2, "https://www.uni.example/p", text, "Nobody Verma", "uni.example")],
                               "record_id int, url string, text string, contact_name string, company_domain string")
    got = [(r.record_id, r.email, r.background) for r in C.address_named_rows(df).collect()]
    assert got == [(1, "verma.ravi@uni.example", "Listed on www.uni.example: Head of Hydrology")]


def test_overrides_of_scope(spark):
    fit = spark.createDataFrame([(i, "Yes", "Official pages support it.") for i in range(3)] + [(3, "Unknown", "Official website has not been supported.")], "record_id int, value string, quote string")
    sites = spark.createDataFrame([(0, "https://a", "supported", False), (1, "https://b", "supported", True), (2, "https://c", "unknown", True)], "record_id int, website string, geography_status string, listed boolean")
    got = {r.record_id: (r.value, r.quote) for r in O.reviewed_fit(fit, sites).collect()}
    assert got == {0: ("Yes", "Official pages support it."), 1: ("Yes", "Public directory pages support it."),
                   2: ("Review", "Geographic identity needs confirmation before assessing fit."), 3: ("Unknown", "Official website has not been supported.")}
