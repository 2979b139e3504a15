"""Columns over names, texts and addresses; each takes and returns columns and stays in the JVM.

Null texts count as empty throughout; a null or empty phrase is found nowhere.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from vouch import constants as K

WORD = r"[\p{L}\p{N}_]+"
#: White space in all scripts; Java's own class is that of ASCII.
SPACES = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def literals(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def mapping(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def folded(text: Column) -> Column:
    """Lower case, with the sharp s spelled out."""
    return F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("ß"), F.lit("ss"))


def words(text: Column) -> Column:
    return F.regexp_extract_all(folded(text), F.lit(WORD), F.lit(0))


def normalized(text: Column) -> Column:
    return F.array_join(words(text), " ")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), the value worked out once a row: what a lambda's body holds is worked out again for each element it looks at."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def padded(text: Column) -> Column:
    """The normalized text between spaces, in which a whole phrase can be looked for."""
    return F.concat(F.lit(" "), normalized(text), F.lit(" "))


def contains_phrase(text: Column, phrase: Column) -> Column:
    target = normalized(phrase)
    return (target != "") & F.contains(padded(text), F.concat(F.lit(" "), target, F.lit(" ")))


def name_tokens(name: Column) -> Column:
    return F.filter(words(name), lambda w: ~w.isin(K.HONORIFICS))


def name_variants(name: Column, surnames: dict[str, str] = K.SURNAME_VARIANTS) -> Column:
    """The name without honorifics, and with its surname's other spelling; none for fewer than two words."""
    tokens = name_tokens(name)
    base = F.array_join(tokens, " ")
    other = F.try_element_at(mapping(surnames), F.try_element_at(tokens, F.lit(-1)))
    start = F.array_join(F.slice(tokens, 1, F.greatest(F.size(tokens) - 1, F.lit(0))), " ")
    both = F.when(other.isNull(), F.array(base)).otherwise(F.array(base, F.concat(start, F.lit(" "), other)))
    return F.when(F.size(tokens) < 2, F.array().cast("array<string>")).otherwise(both)


def contains_person_name(text: Column, name: Column) -> Column:
    return bound(padded(text), lambda page: F.exists(name_variants(name), lambda v: F.contains(page, F.concat(F.lit(" "), v, F.lit(" ")))))


def quoted(text: Column) -> Column:
    return F.concat(F.lit('"'), text, F.lit('"'))


def query_plan(name: Column, company: Column, domain: Column, email: Column) -> Column:
    """At most three distinct searches for a person, by what is known; none for a name of one word."""
    variants = name_variants(name)
    first, second = F.get(variants, F.lit(0)), F.get(variants, F.lit(1))
    known = lambda c: F.nullif(c, F.lit(""))
    company, domain, email = known(company), known(domain), known(email)
    with_company = F.concat(quoted(first), F.lit(" "), quoted(company))
    on_site = F.concat(quoted(first), F.lit(" site:"), domain)
    other_on_site = F.concat(quoted(second), F.lit(" site:"), domain)
    other_anywhere = F.when(company.isNull(), quoted(second)).otherwise(F.concat(quoted(second), F.lit(" "), quoted(company)))
    plan = (
        F.when(first.isNull(), F.array().cast("array<string>"))
        .when(F.coalesce(company, domain, email).isNull(), F.transform(variants, quoted))
        .when(
            domain.isNotNull() & email.isNotNull() & second.isNotNull(),
            F.array(F.coalesce(with_company, on_site), other_on_site, quoted(email)),
        )
        .otherwise(F.array(with_company, on_site, quoted(email), F.when(domain.isNotNull(), other_on_site).otherwise(other_anywhere)))
    )
    return F.slice(F.array_distinct(F.array_compact(plan)), 1, 3)


def person_request_errors(name: Column, company: Column, domain: Column, email: Column, url: Column) -> Column:
    """What is wrong with a request; empty if nothing is."""
    bare = F.regexp_replace(F.trim(F.lower(domain)), r"^www\.", "")
    mail = F.trim(F.lower(email))
    trimmed = F.coalesce(F.trim(name), F.lit(""))
    checks = [
        ((F.length(trimmed) < 3) | (F.length(trimmed) > 120), "name length"),
        (F.size(F.filter(F.split(trimmed, r"\s+"), lambda w: w != "")) < 2, "full name needed"),
        (F.size(name_tokens(trimmed)) < 2, "two name words needed"),
        (F.length(F.trim(company)) > 160, "company length"),
        (F.length(domain) > 255, "domain length"),
        ((domain != "") & (F.contains(bare, F.lit("/")) | ~F.contains(bare, F.lit("."))), "bare domain needed"),
        (F.length(email) > 320, "email length"),
        ((email != "") & ~mail.rlike(r"^[^@]*@[^@]*\.[^@]*$"), "email invalid"),
        (F.length(url) > 2000, "url length"),
    ]
    return F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(why)) for bad, why in checks]))


def emails(text: Column) -> Column:
    """The distinct addresses of a text in order, lower-cased."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(K.EMAIL), F.lit(0))
    return F.array_distinct(F.transform(found, F.lower))


def letters(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z]+"), F.lit(0))


def local_matches_name(email: Column, name: Column) -> Column:
    """Whether the part before the at-sign holds a word of the name, or is one of its short forms."""
    local = F.regexp_replace(F.lower(F.substring_index(F.coalesce(email, F.lit("")), "@", 1)), "[^a-z]", "")
    parts = F.filter(letters(name), lambda w: F.length(w) >= K.NAME_WORD)
    word = {0: F.get(parts, F.lit(0)), -1: F.try_element_at(parts, F.lit(-1))}
    forms = F.array(*[F.concat(*[word[i] if n is None else F.left(word[i], F.lit(n)) for i, n in form]) for form in K.LOCAL_FORMS])
    return F.exists(parts, lambda w: F.contains(local, w)) | ((F.size(parts) >= 2) & F.array_contains(forms, local))


def same_person(found: Column, wanted: Column) -> Column:
    """Whether each wanted name word of two letters or more is among the found ones."""
    want = F.filter(letters(wanted), lambda w: F.length(w) > 1)
    return (F.size(want) > 0) & (F.size(F.array_except(want, letters(found))) == 0)


def human_name(text: Column) -> Column:
    """Whether a text is two to four capitalized words, none of an office or a role."""
    own = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))
    shape = F.coalesce(text, F.lit("")).rlike(f"^{K.PERSON_NAME}$")
    return shape & ~F.arrays_overlap(own, literals([*K.NON_PERSON_WORDS, *K.ROLE_WORDS]))


def capitalized(text: Column) -> Column:
    """Each word between spaces with its first letter upper and the others lower, letter by letter: a sharp s or a ligature stays one letter."""
    alone = lambda c: F.when(F.length(F.upper(c)) == 1, F.upper(c)).otherwise(c)
    low = lambda w: F.lower(F.replace(w, F.lit("İ"), F.lit("i")))
    return F.array_join(F.transform(F.split(text, " "), lambda w: F.concat(alone(F.left(w, F.lit(1))), low(F.substr(w, F.lit(2))))), " ")


def spelled_out(name: Column) -> Column:
    """Abbreviations by the alphabetically first of their full forms."""
    full = mapping({k: sorted(v)[0] for k, v in K.ABBREVIATIONS.items()})
    own = F.filter(F.split(F.coalesce(name, F.lit("")), r"\s+"), lambda w: w != "")
    bare = lambda w: F.regexp_replace(F.lower(w), r"^[.,]+|[.,]+$", "")
    return F.array_join(F.transform(own, lambda w: F.coalesce(F.try_element_at(full, bare(w)), w)), " ")


def rank_contact(title: Column, generic: Column, context: Column) -> Column:
    """How relevant a contact's position is, 0 to 90, by the table of ranks."""
    low, around = F.lower(F.coalesce(title, F.lit(""))), F.coalesce(context, F.lit(""))
    out = F.when(generic, 0)
    for score, said, near, without in K.CONTACT_RANKS:
        holds = [x.rlike(p) for x, p in ((low, said), (around, near)) if p] + [~around.rlike(p) for p in (without,) if p]
        fits = holds[0]
        for h in holds[1:]:
            fits = fits & h
        out = out.when(fits, score)
    return out.otherwise(K.OTHER_RANK)


def window_around(text: Column, start: Column, length: Column, before: int, after: int) -> Column:
    """Characters from `before` ahead of a place (from 1) to `after` past its end."""
    begin = F.greatest(start - before, F.lit(1))
    return F.substring(text, begin, start + length + after - begin)


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " "))


def relevant_excerpt(page: Column, name: Column, email: Column) -> Column:
    """The surroundings of the first spelling of a name found, and of the address if it isn't in them; else the start."""
    text = collapsed(page)
    low = F.lower(text)
    found = bound(low, lambda t: F.get(F.filter(name_variants(name), lambda v: F.contains(t, v)), F.lit(0)))
    around = F.trim(window_around(text, F.position(found, low), F.length(found), 40, 520))
    mail = F.nullif(F.lower(email), F.lit(""))
    at = F.position(mail, low)
    more = F.concat(F.lit(" ... "), F.trim(window_around(text, at, F.length(mail), 55, 80)))
    add = mail.isNotNull() & ~F.contains(F.lower(around), mail) & (at > 0)
    return F.when(found.isNull(), F.substring(text, 1, 1000)).otherwise(
        F.substring(F.when(F.coalesce(add, F.lit(False)), F.concat(around, more)).otherwise(around), 1, 1000)
    )


def hit_excerpt(body: Column, name: Column) -> Column:
    """From 160 characters ahead of a name to 240 past it; else the first 400."""
    text = F.coalesce(body, F.lit(""))
    at = F.position(F.lower(name), F.lower(text))
    return F.when((F.coalesce(name, F.lit("")) != "") & (at > 0), window_around(text, at, F.length(name), 160, 240)).otherwise(F.substring(text, 1, 400))


def clean_document_text(text: Column, most: int) -> Column:
    return F.substring(collapsed(text), 1, most)


def geography_supported(state: Column, text: Column) -> Column:
    """Whether a text names a state or an address in it; unknown states are supported."""
    code = F.upper(F.coalesce(state, F.lit("")))
    full = F.try_element_at(mapping(K.STATES), code)
    zip_code = F.regexp_like(F.coalesce(text, F.lit("")), F.concat(F.lit(r"\b"), code, F.lit(r"\s+\d{5}(?:-\d{4})?\b")))
    return full.isNull() | contains_phrase(text, full) | zip_code


def org_query_plan(name: Column, state: Column, county: Column, country: Column, record_type: Column, contact: Column, domain: Column, kind: str) -> Column:
    """Searches for an organization: kind is website, listing, named or company."""
    blank = lambda c: F.coalesce(c, F.lit(""))
    place = F.when(F.upper(blank(country)).isin("US", "USA"), "United States").otherwise(blank(country))
    sector = F.when(F.lower(blank(record_type)) == "association", "utility association").otherwise("")
    full, name, state, county, contact = spelled_out(name), blank(name), blank(state), blank(county), blank(contact)
    line = lambda *parts: F.array_join(F.filter(F.split(F.concat_ws(" ", *parts), r"\s+"), lambda w: w != ""), " ")
    plans = {
        "website": [line(full, state, county, place, sector, F.lit("official website")), line(quoted(name), state, place, sector, F.lit("official website"))],
        "listing": [F.concat_ws(" ", quoted(full), state, place, F.lit("directory website email"))],
        "named": [
            F.concat(quoted(contact), F.lit(" site:"), domain), F.concat(quoted(contact), F.lit(" "), quoted(name), F.lit(" email")),
            F.concat(contact, F.lit(" site:"), domain), F.concat_ws(" ", contact, name),
        ],
        "company": [
            F.concat(F.lit("site:"), domain, F.lit(' "@'), domain, F.lit('" staff')),
            F.concat(F.lit('"@'), domain, F.lit('" '), quoted(full), F.lit(" directory filetype:pdf")),
            F.concat(quoted(full), F.lit(" billing finance general manager email")),
        ],
    }
    return F.array_distinct(F.array(*plans[kind]))


def name_forms(word: Column) -> Column:
    """A word of an organization's name, what it abbreviates, and the same kind in another language."""
    forms: dict[str, set[str]] = {k: set(v) for k, v in K.ABBREVIATIONS.items()}
    for kind, aliases in K.SAME_KIND.items():
        forms.setdefault(kind, set()).update(aliases)
        for alias in aliases:
            forms.setdefault(alias, set()).add(kind)
    table = F.create_map(*[x for k, v in forms.items() for x in (F.lit(k), literals(sorted(v)))])
    return F.concat(F.array(word), F.coalesce(F.try_element_at(table, word), F.array().cast("array<string>")))


def organization_tokens(name: Column) -> Column:
    """The words that tell an organization: without parentheses, stop words and repeats."""
    bare = F.regexp_replace(folded(name), r"\([^)]*\)", "")
    return F.array_distinct(F.filter(F.regexp_extract_all(bare, F.lit("[a-z0-9]+(?:-op)?"), F.lit(0)), lambda w: ~w.isin(K.NAME_STOP_WORDS)))


def missing_tokens(name: Column, text: Column) -> Column:
    """The telling words of a name that stand in no form, between word boundaries, in a text."""
    page = F.concat(F.lit(" "), F.array_join(F.regexp_extract_all(folded(text), F.lit(WORD + r"|-"), F.lit(0)), " "), F.lit(" "))
    spaced = lambda f: F.concat(F.lit(" "), F.regexp_replace(f, r"-", " - "), F.lit(" "))
    # Each word, and each form of it, is paired with the page, which is so made once. No inner lambda holds an outer one's
    # variable: where this is an argument of a Python function below a union, Spark doesn't recognize such an argument again.
    tokens = organization_tokens(name)
    stands = lambda p, forms: F.exists(F.zip_with(F.array_repeat(p, F.size(forms)), forms, lambda q, f: F.contains(q, spaced(f))), lambda x: x)
    return F.array_compact(F.zip_with(F.array_repeat(page, F.size(tokens)), tokens, lambda p, w: F.when(~stands(p, name_forms(w)), w)))


def organization_named(name: Column, text: Column) -> Column:
    """Whether a text names an organization, every telling word spelled right."""
    return contains_phrase(text, name) | ((F.size(organization_tokens(name)) > 0) & (F.size(missing_tokens(name, text)) == 0))
