"""Recruitment tables derived from the relational test tables.

Each view is one SELECT that Spark and the checking engine both understand; ``{name}`` marks a table or another
view. On real data these views are simply the stored tables of the same names.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..plans.skew import plan_bytes

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()

VIEWS: dict[str, str] = {
    "skills": """
        SELECT min(p_partkey) AS skill_id, p_name AS name,
               CASE length(p_name) % 3 WHEN 0 THEN 'tech' WHEN 1 THEN 'soft' ELSE 'language' END AS category
        FROM {part} GROUP BY p_name""",
    "customer_orders": """
        SELECT o_custkey AS candidate_id, max(o_orderdate) AS last_order, min(year(o_orderdate)) AS first_year,
               max(year(o_orderdate)) AS last_year, count(*) AS n_orders
        FROM {orders} GROUP BY o_custkey""",
    "candidates": """
        SELECT c.c_custkey AS candidate_id,
               CASE WHEN c.c_custkey % 13 = 0 THEN NULL ELSE c.c_custkey + 100000 END AS user_id,
               CASE WHEN c.c_custkey % 41 = 7 THEN 'Unknown' WHEN c.c_custkey % 43 = 7 THEN ''
                    WHEN c.c_custkey % 47 = 7 THEN 'Test Person' ELSE c.c_name END AS full_name,
               CASE WHEN c.c_custkey % 53 = 7 THEN 'candidate-' || CAST(c.c_custkey AS STRING) || '@mail.example'
                    ELSE lower(replace(c.c_name, '#', '')) || '@example.com' END AS email,
               CASE WHEN c.c_custkey % 5 = 0 THEN NULL
                    ELSE '+33 6 12-34 ' || lpad(CAST(c.c_custkey % 100 AS STRING), 2, '0') || ' 07' END AS phone,
               CASE WHEN c.c_custkey % 3 = 0 THEN 'https://linkedin.com/in/c' || CAST(c.c_custkey AS STRING) END
                    AS linkedin_url,
               CASE WHEN c.c_custkey % 59 = 7 THEN NULL WHEN c.c_custkey % 61 = 7 THEN '  '
                    ELSE c.c_name || ' works in ' || c.c_mktsegment || ' with ' ||
                         CAST(c.c_custkey % 14 AS STRING) || '+ years of practice' END AS raw_text,
               coalesce(o.last_order, CAST('1990-01-01' AS TIMESTAMP)) AS created_at,
               CASE WHEN c.c_custkey % 67 = 7 THEN NULL ELSE CAST(c.c_custkey % 5 * 25 AS DOUBLE) END AS quality_pct,
               c.c_custkey % 7 = 0 AS is_fully_extracted,
               CASE c.c_custkey % 4 WHEN 0 THEN '["Senior ' || lower(c.c_mktsegment) || ' engineer","Analyst"]'
                    WHEN 1 THEN '["Analyst"]' WHEN 2 THEN 'Lead buyer' ELSE NULL END AS extracted_job_titles,
               CASE c.c_custkey % 3 WHEN 0 THEN '["' || c.c_mktsegment || ' Works"]' WHEN 1 THEN '[]' ELSE NULL END
                    AS extracted_companies,
               CASE c.c_custkey % 2 WHEN 0 THEN '["Master of Science 2015"]' ELSE '["Bachelor","BTS 2012"]' END
                    AS extracted_education,
               CASE c.c_custkey % 4
                    WHEN 0 THEN '{"skills":["ml","node js"],"languages":["English"],"experiences":[],"projects":[],'
                         || '"certifications":[],"github_urls":[],"portfolio_urls":[]}'
                    WHEN 1 THEN '{"skills":[{"name":"Python"},{"name":"sql"},"python"],"languages":[]}'
                    WHEN 2 THEN 'not json' ELSE NULL END AS ner_json,
               c.c_nationkey AS nation_id, c.c_mktsegment AS segment
        FROM {customer} c LEFT JOIN {customer_orders} o ON o.candidate_id = c.c_custkey""",
    "candidate_skills": """
        SELECT o_custkey AS candidate_id, s.skill_id, s.name AS skill,
               CASE WHEN max(l_quantity) >= 45 THEN 'expert' WHEN max(l_quantity) >= 30 THEN 'advanced'
                    WHEN max(l_quantity) >= 15 THEN 'intermediate' ELSE 'beginner' END AS proficiency
        FROM {lineitem} l JOIN {orders} o ON o.o_orderkey = l.l_orderkey
             JOIN {part} p ON p.p_partkey = l.l_partkey JOIN {skills} s ON s.name = p.p_name
        WHERE l_returnflag = 'R' GROUP BY o_custkey, s.skill_id, s.name""",
    "job_criteria": """
        SELECT s_suppkey AS criteria_id, s_nationkey AS recruiter_id,
               CASE s_suppkey % 4 WHEN 0 THEN 'Senior Engineer ' WHEN 1 THEN 'Data Analyst ' WHEN 2 THEN
                    'Junior Developer ' ELSE 'Master planner ' END || s_name AS title,
               CASE s_suppkey % 5 WHEN 0 THEN NULL
                    WHEN 1 THEN 'Minimum of ' || CAST(s_suppkey % 9 + 1 AS STRING) || '+ years with python and sql'
                    WHEN 2 THEN 'Fintech bank, docker and aws, communication, ' || CAST(s_suppkey % 6 AS STRING) || ' ans'
                    WHEN 3 THEN 'Expert in machine learning; English and French; PhD; retail SaaS'
                    ELSE 'Planning small ring and red widget work' END AS description,
               CAST('2020-01-01' AS TIMESTAMP) + INTERVAL '1' DAY * CAST(s_suppkey % 700 AS INT) AS created_at
        FROM {supplier}""",
    "criteria_volume": """
        SELECT l_suppkey AS criteria_id, p.p_name AS skill, CAST(sum(l_quantity) AS BIGINT) AS volume
        FROM {lineitem} l JOIN {part} p ON p.p_partkey = l.l_partkey GROUP BY l_suppkey, p.p_name""",
    "criteria_skills": """
        SELECT v.criteria_id * 10 + v.pos AS id, v.criteria_id, s.skill_id, v.skill, v.volume % 100 + 1 AS weight
        FROM (SELECT *, row_number() OVER (PARTITION BY criteria_id ORDER BY volume DESC, skill) AS pos
              FROM {criteria_volume}) v JOIN {skills} s ON s.name = v.skill
        WHERE v.pos <= 5""",
    "favorites": """
        SELECT min(o.o_orderkey) AS id, c.c_nationkey AS recruiter_id, o.o_custkey AS candidate_id,
               min(o.o_orderdate) AS created_at
        FROM {orders} o JOIN {customer} c ON c.c_custkey = o.o_custkey
        WHERE o.o_orderpriority = '1-URGENT' GROUP BY c.c_nationkey, o.o_custkey""",
    "raw_skills": """
        SELECT p_partkey AS row_id, p_size AS owner_id,
               CASE p_partkey % 16 WHEN 0 THEN 'ml' WHEN 1 THEN ' JS ' WHEN 2 THEN 'node/js' WHEN 3 THEN 'react.js'
                    WHEN 4 THEN 'c++' WHEN 5 THEN 'k8s;' WHEN 6 THEN '(Docker-Compose)' WHEN 7 THEN 'ci/cd'
                    WHEN 8 THEN '' WHEN 9 THEN NULL WHEN 10 THEN 'scikit learn' WHEN 11 THEN 'r' WHEN 12 THEN 'FASTAPI'
                    ELSE p_name END AS raw
        FROM {part}""",
    "cv_texts": """
        SELECT c.c_custkey AS cv_id, concat_ws(chr(10),
            c.c_mktsegment || ' ' || upper(translate(CAST(c.c_custkey AS STRING), '0123456789', 'abcdefghij')),
            'client.n' || CAST(c.c_custkey AS STRING) || '@mail' || CAST(c.c_custkey % 7 AS STRING) || '.example.com',
            CASE WHEN c.c_custkey % 3 = 2 THEN '06 12 34 ' ELSE '+33 6 12 34 ' END
                || lpad(CAST(c.c_custkey % 100 AS STRING), 2, '0') || ' ' || lpad(CAST(c.c_custkey % 97 AS STRING), 2, '0'),
            CASE WHEN c.c_custkey % 4 = 0 THEN 'linkedin.com/in/client-' || CAST(c.c_custkey AS STRING) || '.' END,
            CASE WHEN c.c_custkey % 6 = 0 THEN 'https://github.com/client' || CAST(c.c_custkey AS STRING) || '/tools' END,
            CASE WHEN c.c_custkey % 10 = 0 THEN 'www.client' || CAST(c.c_custkey AS STRING) || '.dev/cv' END,
            CASE c.c_custkey % 5 WHEN 1 THEN 'Paris, France' WHEN 2 THEN 'Lyon , France' WHEN 3 THEN 'Berlin, Germany' END,
            CASE WHEN c.c_custkey % 4 = 1 THEN 'PROFIL' WHEN c.c_custkey % 4 = 2 THEN 'Professional Summary' END,
            CASE WHEN c.c_custkey % 4 IN (1, 2) THEN 'Team member with passion for ' || lower(c.c_mktsegment)
                || ' and ' || CAST(c.c_custkey % 12 + 1 AS STRING) || '+ years in the field.' END,
            CASE WHEN c.c_custkey % 3 = 0 THEN 'EXPERIENCE' WHEN c.c_custkey % 3 = 1 THEN 'Expériences professionnelles' END,
            CASE WHEN c.c_custkey % 2 = 0
                THEN 'Senior Engineer - ' || n.n_name || ' Works (' || CAST(coalesce(o.first_year, 2000) AS STRING) || '-'
                    || CAST(coalesce(o.last_year, 2001) AS STRING) || ')'
                ELSE 'Lead Developer' || chr(10) || initcap_segment || ' Works | ' || CAST(coalesce(o.first_year, 2000) AS STRING)
                    || ' - present' END,
            '- Built data pipelines for the sales team',
            CASE WHEN c.c_custkey % 7 = 0 THEN '• Implemented reporting for ' || lower(c.c_mktsegment) END,
            CASE WHEN c.c_custkey % 2 = 0 THEN 'EDUCATION' ELSE 'Formation' END,
            'Master of Science ' || CAST(coalesce(o.first_year, 2000) - 1 AS STRING),
            CASE WHEN c.c_custkey % 9 = 0 THEN 'Licence Université de Lyon | 1998' END,
            CASE WHEN c.c_custkey % 2 = 0 THEN 'SKILLS' ELSE 'Compétences' END,
            CASE WHEN c.c_custkey % 8 <> 5 THEN 'python, sql, docker, machine learning' END,
            k.skill_list, 'Communication',
            CASE WHEN c.c_custkey % 3 = 0 THEN 'LANGUES' || chr(10) || 'Français, Anglais' WHEN c.c_custkey % 3 = 1
                THEN 'LANGUAGES' || chr(10) || 'English German' END,
            CASE WHEN c.c_custkey % 5 = 0 THEN 'Certifications' || chr(10) || '- AWS Certified Architect' WHEN
                c.c_custkey % 5 = 1 THEN 'TOEIC 900' END,
            CASE WHEN c.c_custkey % 6 = 1 THEN 'PROJETS' || chr(10) || '- Sales forecast for ' || c.c_mktsegment END,
            CASE WHEN c.c_custkey % 7 = 2 THEN 'Centres d''intérêt' || chr(10) || 'Chess' || chr(10) || 'Hiking' END
        ) AS text
        FROM (SELECT *, upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) AS initcap_segment
              FROM {customer}) c
             JOIN {nation} n ON n.n_nationkey = c.c_nationkey
             LEFT JOIN {customer_orders} o ON o.candidate_id = c.c_custkey
             LEFT JOIN {cv_skill_lists} k ON k.candidate_id = c.c_custkey""",
    # The one place where the two engines spell an ordered string aggregate differently; see _SPARK_VIEWS.
    "cv_skill_lists": """
        SELECT candidate_id, string_agg(skill, ', ' ORDER BY skill) AS skill_list
        FROM {candidate_skills} GROUP BY candidate_id""",
    "scored_pairs": """
        SELECT l.doc_id AS pair_id, d.source AS source, l.quality AS label,
               CAST((d.n_chars * 7 + l.quality * 37 + l.doc_id % 13) % 101 AS DOUBLE) / 100 AS score,
               CAST((d.n_chars * 3 + l.quality * 29) % 101 AS DOUBLE) / 100 AS score_b
        FROM {labels} l JOIN {documents} d ON d.doc_id = l.doc_id""",
}

_SPARK_VIEWS = {
    "cv_skill_lists": """
        SELECT candidate_id, array_join(array_sort(collect_list(skill)), ', ') AS skill_list
        FROM {candidate_skills} GROUP BY candidate_id""",
}

_REFERENCE = re.compile(r"\{([a-z_]+)\}")


def references(sql: str) -> list[str]:
    return list(dict.fromkeys(_REFERENCE.findall(sql)))


# Tables whose queries are bound by the work per row (long texts) and not by the bytes read.
TEXT_TABLES = {"documents": ["documents"], "cv_texts": ["customer", "orders"]}


def spread(df: DataFrame, source_bytes: int) -> DataFrame:
    """Spread a small text table over all cores.

    A table of many files is already split; a few small files would leave most cores idle. Nothing is shuffled once the
    sources hold more than one full split per core.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())  # the setting may carry a unit
    return df.repartition(cores) if source_bytes < cores * split else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table or a derived view by name; only the columns a query uses are read."""
    def base(n: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir.rstrip('/')}/{n}.parquet")

    if name in BASE_TABLES:
        df = base(name)
    else:
        sql = _SPARK_VIEWS.get(name, VIEWS[name])
        inputs = {ref: table(spark, sf_dir, ref) for ref in references(sql)}
        if name == "candidates":  # braces of its JSON literals are no references
            sql = sql.replace('{"', '{{"').replace('"}', '"}}').replace("[]}", "[]}}")
        # Zone-free timestamps, as in the base tables.
        df = spark.sql(sql.replace("AS TIMESTAMP)", "AS TIMESTAMP_NTZ)"), **inputs)
    if name in TEXT_TABLES:
        df = spread(df, sum(plan_bytes(base(n)) for n in TEXT_TABLES[name]))
    return df


def with_views(body: str, extra: dict[str, str] | None = None) -> str:
    """The body as SQL for the checking engine, preceded by the views it refers to."""
    known = {**VIEWS, **(extra or {})}
    ordered: dict[str, str] = {}

    def visit(sql: str) -> str:
        for ref in references(sql):
            if ref in known and ref not in ordered:
                text = visit(known[ref])
                ordered[ref] = text
        return _REFERENCE.sub(lambda m: m.group(1), sql)

    text = visit(body).strip()
    if not ordered:
        return text
    ctes = ",\n".join(f"{name} AS ({sql.strip()})" for name, sql in ordered.items())
    return f"WITH {ctes}\n{text}"
