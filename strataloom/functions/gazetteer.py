"""Names that the extraction knows, by type, each with its other spellings; and words that name nothing."""

from __future__ import annotations

KNOWN = """
Technology
Apache AGE: AGE, Apache Graph Extension
PostgreSQL: Postgres, PG, PostgreSQL Database
DuckDB: DuckDB Engine
dbt: dbt Core, data build tool
MetricFlow: MetricFlow Engine
DataHub: LinkedIn DataHub
Palantir Foundry: Foundry Ontology
OneTrust: OneTrust Privacy
Stardog: Stardog KG, Stardog Union
Apache Ossie: Ossie
Dremio: Dremio Semantic Layer
AtScale: AtScale Semantic Layer
Cube: Cube.js
Daana: Daana Platform
Cypher: openCypher, Cypher Query Language, Cypher Query
FastAPI: FastAPI Framework
Streamlit: Streamlit Web UI, Streamlit Dashboard, Streamlit UI, Streamlit Visualization
Docker: Docker Container
Git: GitHub, GitLab
Linux: Ubuntu, Debian
Python: Python3, Python Programming, Python Application
SQL: Structured Query Language, ANSI SQL
Power BI: Microsoft Power BI
Tableau: Tableau Desktop
Excel: Microsoft Excel
Java: Java SE
C++: CPP
Pandas: Pandas DataFrame
NumPy: NumPy Array
Scikit-Learn: sklearn
TensorFlow: TF
PyTorch: Torch
PySpark: Apache Spark
Airflow: Apache Airflow
Kafka: Apache Kafka
Snowflake: Snowflake Data Cloud
BigQuery: Google BigQuery
LookML: Looker LookML
Looker: Google Looker
Delta Lake: Delta Tables
Apache Iceberg: Iceberg Catalog
Apache Arrow: PyArrow
GraphQL: GraphQL API
REST API: RESTful Services
Jupyter: Jupyter Notebook
VS Code: Visual Studio Code

Concept
Context Lakehouse: Data Lakehouse, Context Engine
Traditional Lakehouse: Traditional Data Lakehouse
Semantic Layer: Semantic Fabric, Metrics Layer
Context Layer: Shared Context Layer
Knowledge Graph: Graph DB, KG, Knowledge Graph Architecture
Graph Database: Graph Store
Relational Database: RDBMS, Relational Engine, Relational Data, Relational Tables
Semantic Catalog: semantic_catalog.json, Semantic Metadata
Open Knowledge Format: OKF
Open Semantic Interchange: OSI
Machine Learning: ML, Predictive Modeling, AI Reasoning, LLM Reasoning
Deep Learning: Neural Networks
Data Engineering: Data Pipeline
Data Analytics: Analytics, Business Intelligence, BI
Operational Data: Operational Systems
Analytical Data: Analytical Datasets
Product Events: User Events
Telemetry: Logs and Traces, Telemetry Logs
Documents: Business Knowledge, Runbooks
Business Definitions: Business Rules, Metric Definitions
Ontology: Semantic Ontology
Data Governance: Governance, Access Control
Data Catalog: Metadata Platform
Data Lake: Lake Storage
Data Warehouse: DWH
ETL: Extract Transform Load
ELT: Extract Load Transform
RAG: Retrieval Augmented Generation
Vector Database: Vector Store
Natural Language Processing: NLP
AI Agents: Autonomous Agents

Organization
Palantir: Palantir Technologies
LinkedIn: LinkedIn Corp
Google: Google Cloud
Microsoft: MSFT
Amazon: AWS
Meta: Facebook
Databricks: Databricks Inc
dbt Labs: Fishtown Analytics
Apache Software Foundation: Apache
OpenAI: OpenAI Inc
"""


def known(text: str = KNOWN) -> list[tuple[str, str, list[str]]]:
    """(canonical name, type, other spellings) in order."""
    out = []
    for part in text.strip().split("\n\n"):
        kind, *lines = part.splitlines()
        out += [(name, kind, [a.strip() for a in rest.split(",") if a.strip()]) for name, _, rest in (line.partition(": ") for line in lines)]
    return out


# Headings and common words that are no entities.
NOT_NAMES = frozenset(
    (
        "EDUCATION,EXPERIENCE,WORK EXPERIENCE,SKILLS,TECHNICAL SKILLS,KEY SKILLS,PROJECTS,ACADEMIC PROJECTS,PERSONAL PROJECTS,SUMMARY,PROFESSIONAL SUMMARY,PROFILE,OBJECTIVE,CAREER OBJECTIVE,CERTIFICATIONS,ACHIEVEMENTS,AWARDS,LANGUAGES,INTERESTS,HOBBIES,CONTACT,CONTACT DETAILS,PHONE,EMAIL,ADDRESS,DATE,DURATION,ROLE,"
        "RESPONSIBILITIES,DESCRIPTION,DETAILS,OVERVIEW,INTRODUCTION,CONCLUSION,PRESENT,CURRENT,JANUARY,FEBRUARY,MARCH,APRIL,MAY,JUNE,JULY,AUGUST,SEPTEMBER,OCTOBER,NOVEMBER,DECEMBER,JAN,FEB,MAR,APR,JUN,JUL,AUG,SEP,OCT,NOV,DEC,YEAR,MONTH,COLLEGE,SCHOOL,BACHELOR,MASTER,DEGREE,B.TECH,BTECH,M.TECH,MTECH,BSC,MSC,CGPA,"
        "PERCENTAGE,INDIA,ENGLISH,TELUGU,HINDI,RESUME,CURRICULUM VITAE,CV,PAGE,REPORT,FIGURE,TABLE,SECTION,CHAPTER,TITLE,NAME,CITY,STATE,COUNTRY,ACTIVITY,ACTIVITIES,TEAM,MEMBER,LEAD,LEADER,INTERN,INTERNSHIP,ASSOCIATE,ENGINEER,DEVELOPER,ANALYST,STUDENT,FRESHER,RESULT,RESULTS,SCOPE,FEATURE,FEATURES,METHODOLOGY,"
        "ARCHITECTURE,IMPLEMENTATION,TESTING,VERIFICATION,REFERENCE,REFERENCES,APPENDIX,THE,THIS,THAT,THESE,THOSE,WHEN,WHAT,WHERE,WHICH,BECAUSE,HOWEVER,FIRST,SECOND,THIRD,MAIN,HIGH,LOW,GOOD,BETTER,BEST,USER,USERS,HUMAN,HUMANS,APPLICATION,APPLICATIONS,SYSTEM,SYSTEMS,PROCESS,PROCESSES,MODEL,MODELS,DATA,INFORMATION,"
        "AND,FOR,WITH,FROM,ABOUT,OVER,UNDER,AFTER,BEFORE,EVALUATED,PARTICIPATED,ACHIEVED,CONTRIBUTED,DESIGNED,BUILT,DEVELOPED,CREATED,MANAGED,PERFORMED,WORKED,STUDIED,USED,PURPOSE,PREREQUISITES,SETUP,SCHEMA,BUILDING,CONFIGURATION,EXECUTION,PROCESSING,EXPLAIN,EXAMPLE,ID,IDENTIFIER,DEPARTMENT,COLUMN,COLUMNS,ROW,ROWS,"
        "RECORD,RECORDS,SHEET,SHEETS,WORKBOOK,FIELD,FIELDS,KEY,KEYS,VALUE,VALUES,INDEX,DATA TYPE,TYPES,TOTAL ROWS,TOTAL RECORDS,TOTAL COLUMNS,SAMPLE RECORDS"
    ).split(",")
)
