"""Hand-derived vectors per rule, and general properties."""

from pyspark.sql import functions as F

from leadloom.functions import company, domain, email, location, person, phone, query, score, title, url
from leadloom.operators import ledger, pages


def lit(x):
    return F.lit(x).cast("string") if x is None else F.lit(x)


def check(values, fn, cases):
    got = values([fn(*(lit(a) for a in args)) for args, _ in cases])
    assert got == [want for _, want in cases]


def test_bare_domain(values):
    check(values, url.bare_domain, [
        (("http://www.c1.co.uk/x",), "c1.co.uk"), (("https://C2.com",), "c2.com"), (("c3.com.ng",), "c3.com.ng"),
        (("https://www.c7.co.ke:8080/p#t",), "c7.co.ke"), ((None,), ""), (("HTTPS://WWW.C6.IO/?a=1",), "c6.io")])


def test_bare_domain_is_idempotent(values):
    samples = ["http://www.a.com/x?y", "B.ORG.", "https://www.c.co.uk:1/#z"]
    assert values([url.bare_domain(url.bare_domain(F.lit(s))) == url.bare_domain(F.lit(s)) for s in samples]) == [True] * 3


def test_absolute_url(values):
    base = "https://a.com/x/y"
    check(values, url.absolute_url, [
        (("/t", base), "https://a.com/t"), (("t", base), "https://a.com/t"), (("//b.com/z", base), "https://b.com/z"),
        (("mailto:a@b.com", base), None), (("http://c.com", base), "http://c.com")])


def test_company_names(values):
    check(values, company.normalize_company, [(("Acme, Inc.",), "acme inc"), (("A & B",), "a  b")])
    check(values, company.similarity, [(("acme", "acmes"), 0.8), (("kitten", "sitting"), 4 / 7), (("", ""), 1.0)])
    assert values([company.similarity(F.lit("abc"), F.lit("abd")) == company.similarity(F.lit("abd"), F.lit("abc"))]) == [True]


def test_phones(values):
    cases = [(("+234 803 123 4567", None), "+2348031234567", "NG"), (("+44 20 7946 0958", None), "+442079460958", "GB"),
             (("254712345678", "ke"), "+254712345678", "KE"), (("(212) 555-0101", "us"), "+12125550101", "US"),
             (("(212) 555-0101", "ca"), "+12125550101", "CA"), (("(212) 555-0101", None), "+2125550101", "MA"),
             (("0803 123 4567", "ng"), "+23408031234567", "NG")]
    for (raw, country), formatted, where in cases:
        f = phone.format_phone(lit(raw), lit(country))
        assert values([f, phone.phone_country(f, lit(country))]) == [formatted, where]
    none, = values([phone.extract_phones(F.lit("tel:0803 123 4567"), F.lit("https://a.com"))])
    assert none == []


def test_email_scores(values):
    cases = {"jane.smith@acme.com": (85, "valid"), "j.smith@acme.com": (90, "valid"), "jane@acme.com": (75, "risky"),
             "jane@acme.fr": (70, "risky"), "x@y.co": (70, "risky"), "info@acme.com": (20, "risky"), "jane99@acme.com": (30, "risky"),
             "a@mailinator.com": (10, "risky"), "bad@": (0, "invalid")}
    got = values([email.syntax_check(F.lit(m)) for m in cases])
    assert [(g.score, g.status) for g in got] == list(cases.values())


def test_generated_emails(values):
    assert values([
        email.email_from_shape(lit("John Q Baker"), lit("firstInitial.last"), lit("."), lit("a.com")),
        email.email_from_shape(lit("Madonna"), lit("first.last"), lit("."), lit("a.com")),
        email.email_from_template(lit("John Baker"), lit("{firstinitial}{lastname}@a.com"), lit("https://a.com")),
        email.email_from_template(lit("Dr. John Baker"), lit("{firstinitial}{lastname}@a.com"), lit("https://a.com")),
        email.email_from_template(lit("John Baker"), lit("{firstname}"), lit("https://www.a.com")),
        email.email_from_template(lit("Madonna"), lit("{firstname}"), lit("https://a.com")),
        email.usable_template(lit("{firstname}.lastname")), email.usable_template(lit("{firstname}.{lastname}")),
    ]) == ["j.baker@a.com", None, "jbaker@a.com", "jbaker@a.com", "john@a.com", None, None, "{firstname}.{lastname}"]


def test_titles(values):
    cases = [("CTO", "Chief Technology Officer", "executive", "General"), ("Co-Founder", "Chief Executive Officer", "executive", "Executive"),
             ("Head of Sales", "Director", "senior", "Sales"), ("Operations Manager", "Operations Manager", "mid", "Operations"),
             ("Junior Accountant", "Junior Accountant", "junior", "Finance"), ("Director", "Director", "senior", "General"),
             ("Vice President of Sales", "Vice President", "executive", "Sales"), ("Marketing Coordinator", "Coordinator", "mid", "Marketing"),
             (None, None, "mid", "General")]
    for t, *want in cases:
        assert values([title.normalize_title(lit(t)), title.seniority(lit(t)), title.department(lit(t))]) == want


def test_person_names(values):
    names = {"John Baker": True, "Mary Stone": True, "Madonna": False, "john baker": False, "Andrew Hill": True, "George Ward": True,
             "Book Now": False, "Monday Friday": False, "April Jones": True}
    assert values([person.is_person_name(F.lit(n)) for n in names]) == list(names.values())
    assert values([person.is_department_name(F.lit("Corporate Banking")), person.is_search_person_name(F.lit("John Baker"))]) == [True, True]


def test_company_attributes(values):
    check(values, company.employee_count, [(("We have 1,250 employees",), 1250), (("We have 1400 employees",), 1400), (("25000 people",), 25000), (("no number",), None), (('"numberOfEmployees": "7"',), 7)])
    assert values([company.employee_range(F.lit(n)) for n in (10, 11, 200, 1000, 1001, 0)]) == [
        "1-10", "11-50", "51-200", "501-1000", "1000+", None]
    assert values([company.employees_from_size(F.lit(s)) for s in ("micro", "Small", "large", "other")]) == [5, 25, 500, None]
    assert values([company.founded_year(F.lit(t), 2026) for t in ("Founded in 1999", "founded 1500")]) == [1999, None]
    assert values([company.has_hiring_words(F.lit(t)) for t in ("Now hiring", "apply now", "hello")]) == [True, True, False]


def test_locations(values):
    got = values([location.parse_location(lit(a), lit(None)) for a in ("12 Marina, Lagos, Nigeria", "Nairobi, Kenya", "Milwaukee, WI")])
    assert [(g.city, g.state, g.country) for g in got] == [("12 Marina", "Lagos", "NG"), ("Nairobi", None, "KE"), ("Milwaukee", None, None)]
    check(values, location.location_distance_km, [
        (("Lagos", "Abuja"), 525.9), (("Nairobi", "Mombasa"), 439.9), (("London", "Manchester"), 262.0), (("Mombasa", "Nairobi"), 439.9),
        (("Lagos", "12 Road, Ikeja, Lagos"), 0.0), (("Nowhere", "Lagos"), None)])


def test_directory_and_names(values):
    sites = {"https://acme.com/about": False, "https://businessdirectory1.com/listings/1": True, "https://www.yelp.com/biz/x": True,
             "https://hubspot.com/": False}
    assert values([domain.is_directory_site(F.lit(s)) for s in sites]) == list(sites.values())
    assert values([domain.is_place_id(F.lit(n)) for n in ("ChIJ9TCVpbKNOxARdEJJj7-rgEE", "ChIJ")]) == [True, False]
    assert values([domain.is_person_query(F.lit(n)) for n in ("John Smith", "Dr. Smith", "phone stores in Abuja")]) == [True, True, False]
    hosts = {"example.com": True, "shop.example.com": True, "mydomain.com": False, "acme.com": False, "localhost": True, "x.test": True}
    assert values([domain.is_placeholder_host(F.lit(h)) for h in hosts]) == list(hosts.values())
    assert values([domain.is_placeholder_host(F.lit("a.example.com"), ("example",))]) == [False]


def test_queries(values):
    none = lit(None)
    a, b = values([query.parse_query(lit(q), none, none, none) for q in ("hospitals in New York", "tech companies in Lagos")])
    assert (a.location, a.industry, a.cleaned_query) == ("New York", None, "hospitals")
    assert (b.location, b.industry, b.cleaned_query) == ("Lagos", "companies", "tech")
    assert values([query.concept(F.lit(q)) for q in ("coffee shops", "Clínica", "plumbers")]) == ["Cafe", "Hospital", None]
    assert len(values([query.expansions(F.lit("bank"), F.lit("pt"))])[0]) == 8


LEAD = """named_struct('company_name', {name}, 'website', {site}, 'emails', {emails}, 'phones', array(), 'address', {address}, 'about_text', {about},
 'decision_makers', {people}, 'socials', named_struct('linkedin', {li}, 'twitter', '', 'facebook', '', 'instagram', ''), 'industry', {industry},
 'company_size', {size}, 'email_pattern', {pattern}, 'linkedin_company_url', '', 'contacts', array())"""
EMPTY = dict(name="''", site="''", emails="CAST(array() AS array<struct<email:string,deliverability:struct<score:int,status:string>>>)", address="''", about="''",
             people="CAST(array() AS array<struct<name:string>>)", li="''", industry="''", size="''", pattern="''")
CONTACTS = "CAST(array() AS array<struct<name:string>>)"


def scored(spark, **fields):
    lead = LEAD.format(**(EMPTY | fields)).replace("'contacts', array()", f"'contacts', {CONTACTS}")
    row = spark.range(1).select(F.expr(lead).alias("l")).select("l.*")
    row = row.withColumn("socials", F.struct(*[F.nullif(f"socials.{k}", F.lit("")).alias(k) for k in ("linkedin", "twitter", "facebook", "instagram")]))
    return row.select(score.quality_score().alias("q"), score.verification().alias("v")).first()


def test_quality_score(spark):
    people = "array(named_struct('name', 'John Baker'))"
    mail = "array(named_struct('email', 'a@b.com', 'deliverability', CAST(NULL AS struct<score:int,status:string>)))"
    assert scored(spark, name="'Acme Foods Limited Partners'", site="'https://acme.io'", emails=mail, people=people, address="'x'").q == 5
    assert scored(spark, name="'Princeton Foods'").q == 0
    assert scored(spark, name="'Princeton Food Industries'").q == 1
    assert scored(spark, site="'acme.io'").q == 0
    assert scored(spark, site="'http://shop.example.com'").q == 0
    assert scored(spark, about="repeat('x', 20)").q == 0
    assert scored(spark, about="repeat('x', 21)").q == 1


def test_verification_score(spark):
    full = scored(spark, name="'Acme Foods'", site="'https://www.acmefoods.com'", li="'https://linkedin.com/x'", people="array(named_struct('name', 'John Baker'))",
                  pattern="'{firstname}@acmefoods.com'", industry="'food'", size="'small'", address="'x'").v
    assert full.score == 5
    assert full.sources == ["website_name_match", "linkedin_social_link", "website_decision_makers", "email_pattern_verified", "additional_signals"]
    empty = scored(spark).v
    assert (empty.score, empty.sources) == (0, [])


def test_labels(values):
    assert values([score.quality_label(F.lit(n)) for n in (5, 3, 1, 0)]) == ["high", "medium", "low", "very_low"]
    assert values([score.verification_label(F.lit(n)) for n in (5, 3, 1, 0)]) == ["highly_verified", "verified", "partially_verified", "unverified"]


def test_credit_packs(spark):
    rows = ledger.credit_packs(spark).orderBy("credits").collect()
    assert [(r.credits, r.usd, r.ngn) for r in rows] == [(100, 29, 46400), (500, 129, 206400), (2000, 399, 638400)]


def test_page_email_forms(values):
    html = ('a@acme.io <p>sales [at] acme [dot] io</p> bob@acme[dot]com <i data-email="eEB5LmNvbQ=="></i> x&#64;entity.org '
            'noreply@acme.io test@acme.io')
    got, = values([pages.page_emails(F.lit(html))])
    assert sorted(g.email for g in got) == sorted(["a@acme.io", "x@entity.org", "bob@acme.com", "sales@acme.io", "x@y.com"])
    plain, = values([pages.page_emails(F.lit("I work at home and dot it"))])
    assert plain == []
