"""Job titles: normal form and classification by rules in order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns, their labels, the reasons given and scores, which results must show as they are.
NOISE = ("remote", "hybrid", "onsite", "on site", "usa", "us", "united states")
ABBREVIATIONS = ((r"\bsr\b", "senior"), (r"\bjr\b", "junior"), (r"\bbi\b", "business intelligence"))
_IC = "title is a management role rather than a hands-on IC role"
JUNIOR = ((r"\b(junior|entry level|entry-level|new grad|graduate|internship|intern)\b", "junior", "title indicates a junior or early-career role", 10),)
MANAGEMENT = (
    (r"\b(engineering|analytics|business intelligence|data engineering|data|bi)\s+manager\b", "manager", _IC, 20),
    (r"\b(manager|director|vp|vice president|head of)\b.*\b(data|analytics|business intelligence|bi|engineering)\b", "management", _IC, 20),
    (r"\b(data|analytics|business intelligence|bi|engineering)\b.*\b(manager|director|vp|vice president)\b", "management", _IC, 20),
)
EXCLUDED = (
    (r"^[^a-z0-9]+$", "malformed punctuation", "title is malformed punctuation", 0),
    (r"^hi\s+there\b", "email greeting", "title is an email greeting", 0),
    (r"^\[", "malformed link text", "title is malformed link text", 0),
    (r"\bsoftware\s+(engineer|developer)\b", "software engineer", "primary job family is Software Engineering", 5),
    (r"\bapplication\s+developer\b", "application developer", "primary job family is Application Development", 10),
    (r"\b(java|oracle)\s+developer\b", "specialist developer", "primary job family is a non-target specialist developer role", 10),
    (r"\bbackend\s+(software\s+)?(engineer|developer)\b", "backend engineer", "primary job family is Software Engineering", 10),
    (r"\bfront\s*end\s+(engineer|developer)\b", "frontend engineer", "primary job family is Software Engineering", 10),
    (r"\bfull\s*stack\s+(engineer|developer)\b", "full stack engineer", "primary job family is Software Engineering", 10),
    (r"\b(mobile|ios|android)\s+(engineer|developer)\b", "mobile engineer", "primary job family is Mobile Engineering", 10),
    (r"\b(machine learning|ml|ai|generative ai|deep learning|nlp|computer vision|mlops)\s+engineer\b", "machine learning engineer", "primary job family is Machine Learning or AI Engineering", 10),
    (r"\b(data|applied|research)\s+scientist\b", "data scientist", "primary job family is Data Science", 10),
    (r"\b(devops|site reliability|sre|network|security|cybersecurity|cloud infrastructure|infrastructure)\s+(engineer|administrator|analyst)\b", "infrastructure", "primary job family is Infrastructure, IT or Security", 10),
    (r"\bsoc\s+analyst\b", "soc analyst", "primary job family is Security Operations", 10),
    (r"\b(database administrator|dba|oracle dba|sql server dba|mysql dba)\b", "database administrator", "primary job family is Database Administration", 10),
    (r"\b(technical\s+)?product\s+(manager|owner)\b", "product manager", "primary job family is Product Management", 10),
    (r"\b(project|program)\s+manager\b", "project manager", "primary job family is Project or Program Management", 10),
    (r"\bscrum\s+master\b", "scrum master", "primary job family is Scrum Master", 10),
    (r"\b(financial|finance|marketing|sales|hr|operations|investment)\s+analyst\b", "business analyst", "primary job family is not target data/BI engineering", 20),
    (r"\bbusiness\s+analyst\b", "business analyst", "primary job family is Business Analysis", 30),
    (r"\b(qa|test)\s+(engineer|analyst)\b", "qa engineer", "primary job family is QA or Testing", 10),
    (r"\b(help desk|desktop support|technical support specialist|network support)\b", "support", "primary job family is IT Support", 10),
    (r"\b(accountant|accounting manager)\b", "accounting", "primary job family is Accounting", 10),
    (r"\b(unqork|aep|rtcdp)\b", "excluded specialist platform", "title focuses on a non-target specialist platform", 20),
    (r"\badobe\s+experience\s+platform\b", "adobe experience platform", "title focuses on Adobe Experience Platform", 20),
)
STRONG = (
    (r"\bdata\s+engineer\b", "data engineer", "Data Engineer is a primary target job family", 95),
    (r"\banalytics\s+engineer\b", "analytics engineer", "Analytics Engineer is a primary target job family", 95),
    (r"\b(business intelligence|bi)\s+engineer\b", "business intelligence engineer", "BI Engineer is a primary target job family", 92),
    (r"\b(business intelligence|bi)\s+developer\b", "business intelligence developer", "BI Developer is a primary target job family", 90),
    (r"\bdata\s+(warehouse|warehousing)\s+engineer\b", "data warehouse engineer", "Data Warehouse Engineering is a primary target job family", 92),
    (r"\bdata\s+integration\s+engineer\b", "data integration engineer", "Data Integration Engineering is a primary target job family", 90),
    (r"\b(etl|elt)\s+engineer\b", "etl engineer", "ETL/ELT Engineering is a primary target job family", 88),
    (r"\bsnowflake\s+(data\s+)?(engineer|developer)\b", "snowflake engineer", "Snowflake data role is a primary target job family", 90),
    (r"\bsnowflake\s+analytics\s+engineer\b", "snowflake analytics engineer", "Snowflake Analytics Engineering is a primary target job family", 94),
    (r"\blooker\s+(developer|engineer|architect|analytics\s+engineer)\b", "looker", "Looker role is a primary target job family", 88),
    (r"\bsemantic\s+(layer\s+)?(engineer|developer|modeler)\b", "semantic layer", "Semantic-layer role is a primary target job family", 88),
    (r"\bmetrics\s+engineer\b", "metrics engineer", "Metrics Engineering is a primary target job family", 86),
    (r"\b(analytics|business intelligence|bi|data analytics|data and analytics)\s+architect\b", "analytics architect", "Analytics/BI architecture is a target job family", 82),
    (r"\bdata\s+warehouse\s+architect\b", "data warehouse architect", "Data Warehouse Architecture is a target job family", 84),
    (r"\bdata\s+and\s+analytics\s+engineer\b", "data and analytics engineer", "Data and Analytics Engineering is a primary target job family", 92),
)
POSSIBLE = (
    (r"\bdata\s+business\s+analyst\b", "data business analyst", "Data business analysis may be relevant", 65),
    (r"\b(data|analytics|business intelligence|bi|technical data)\s+analyst\b", "data analyst", "Analyst title may be relevant after description review", 65),
    (r"\breporting\s+(analyst|developer|engineer)\b", "reporting", "Reporting role may be relevant after description review", 62),
    (r"\b(data|cloud data|data solutions)\s+architect\b", "data architect", "Data architecture title may be relevant after description review", 70),
    (r"\bsolutions\s+architect\b.*\bdata\b", "solutions architect data", "Data-focused solutions architecture may be relevant", 60),
    (r"\bdata\s+platform\s+(engineer|developer)\b", "data platform", "Data platform role may be relevant after description review", 72),
    (r"\bdatabase\s+engineer\b", "database engineer", "Database Engineer may be relevant after description review", 60),
    (r"\b(staff|principal)\s+(data|analytics)\s+engineer\b", "staff/principal data engineer", "Very senior data role may be relevant after description review", 75),
)
OCCUPATIONS = (
    ("data_engineer", r"\bdata\s+engineer\b"),
    ("analytics_engineer", r"\banalytics\s+engineer\b"),
    ("business_intelligence_engineer", r"\b(business intelligence|bi)\s+engineer\b"),
    ("business_intelligence_developer", r"\b(business intelligence|bi)\s+developer\b"),
    ("data_analyst", r"\bdata\s+analyst\b"),
    ("analytics_analyst", r"\banalytics\s+analyst\b"),
    ("software_engineer", r"\bsoftware\s+(engineer|developer)\b"),
    ("machine_learning_engineer", r"\b(machine learning|ml|ai)\s+engineer\b"),
    ("data_scientist", r"\bdata\s+scientist\b"),
    ("database_administrator", r"\b(database administrator|dba)\b"),
)


def normal(title: Column) -> Column:
    """Dashes and brackets evened out, abbreviations spelled out, single words that name places left out."""
    out = F.lower(F.trim(F.coalesce(title, F.lit(""))))
    out = F.replace(F.translate(out, "–—", "--"), F.lit("&"), F.lit(" and "))
    for pattern, by in ((r"[()\[\]{}|/,:;]+", " "), (r"\s+-\s+", " "), (r"[._]+", " "), (r"\s+", " ")):
        out = F.regexp_replace(out, pattern, by)
    out = F.trim(out)
    for pattern, by in ABBREVIATIONS:
        out = F.regexp_replace(out, pattern, by)
    return F.array_join(F.filter(F.split(out, " "), lambda w: (w != "") & ~w.isin(*NOISE)), " ")


def classified(title: Column, normal_title: Column) -> Column:
    """A struct of category, score, reason and pattern of the first rule that fits.

    normal_title is a column with the normal form, so that it is computed once.
    """

    def made(category: str, pattern: str | None, reason: str, score: int) -> Column:
        return F.struct(F.lit(category).alias("category"), F.lit(score).alias("score"), F.lit(reason).alias("reason"), F.lit(pattern).cast("string").alias("matched_pattern"))

    raw = F.trim(F.coalesce(title, F.lit("")))
    rules: list[tuple[Column, Column]] = [
        (raw.startswith("["), made("FILTERED_OUT", "malformed link text", "title is malformed link text", 0)),
        ((raw != "") & ~F.lower(raw).rlike("[a-z0-9]"), made("FILTERED_OUT", "malformed punctuation", "title is malformed punctuation", 0)),
        (normal_title == "", made("POSSIBLE_MATCH", None, "title is missing or blank", 50)),
    ]
    for category, patterns in (("FILTERED_OUT", JUNIOR + MANAGEMENT), ("POSSIBLE_MATCH", POSSIBLE[:1]), ("FILTERED_OUT", EXCLUDED), ("STRONG_MATCH", STRONG), ("POSSIBLE_MATCH", POSSIBLE)):
        rules += [(normal_title.rlike(p), made(category, label, reason, score)) for p, label, reason, score in patterns]
    last = made("POSSIBLE_MATCH", None, "title did not match a configured target or exclusion family", 50)
    return reduce(lambda rest, r: F.when(r[0], r[1]).otherwise(rest), reversed(rules), last)


def occupation(normal_title: Column) -> Column:
    """The first of ten occupations that a normal title names, or null."""
    return F.coalesce(*(F.when(normal_title.rlike(p), F.lit(name)) for name, p in OCCUPATIONS))
