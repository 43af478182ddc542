"""Fixed values of the catalog rules.

Every table here is a fixed value: results depend on the exact words, and where a
list is ordered its order decides ties.
"""

from __future__ import annotations

# --- files and types -------------------------------------------------------

DATA_FILE_SUFFIXES = ["csv", "json", "parquet", "avro", "orc", "txt", "tsv", "xlsx", "xml", "yaml", "yml"]

FILE_TYPES = {
    "csv": "csv_file",
    "json": "json_file",
    "xlsx": "excel_file",
    "xls": "excel_file",
    "parquet": "parquet_file",
    "sql": "sql_file",
    "db": "sqlite_database",
    "sqlite": "sqlite_database",
    "sqlite3": "sqlite_database",
    "txt": "text_file",
    "xml": "xml_file",
    "yaml": "yaml_file",
    "yml": "yaml_file",
}

NETWORK_FILE_TYPES = {
    "csv": "csv_file",
    "json": "json_file",
    "xlsx": "excel_file",
    "xls": "excel_file",
    "parquet": "parquet_file",
    "sql": "sql_file",
    "txt": "text_file",
    "xml": "xml_file",
    "yaml": "yaml_file",
    "yml": "yaml_file",
    "log": "log_file",
}

SFTP_LABELS = {
    "csv": "CSV File",
    "json": "JSON File",
    "xlsx": "Excel File",
    "xls": "Excel File",
    "parquet": "Parquet File",
    "sql": "SQL File",
    "txt": "Text File",
    "xml": "XML File",
    "yaml": "YAML File",
    "yml": "YAML File",
    "log": "Log File",
    "pdf": "PDF File",
    "doc": "Word Document",
    "docx": "Word Document",
    "ppt": "PowerPoint",
    "pptx": "PowerPoint",
    "zip": "Archive",
    "tar": "Archive",
    "gz": "Archive",
}

AZURE_BLOB_TYPES = {
    "csv": "azure_csv_file",
    "json": "azure_json_file",
    "parquet": "azure_parquet_file",
    "xlsx": "azure_excel_file",
    "xls": "azure_excel_file",
    "avro": "azure_avro_file",
    "orc": "azure_orc_file",
}

LOCAL_CATEGORIES = ["data", "database", "export", "backup", "archive", "reports"]
NETWORK_CATEGORIES = ["data", "backup", "archive", "reports", "logs", "export"]
BLOB_FOLDERS = ["data", "raw", "processed", "archive", "backup"]

DATA_CLASSES = [
    (["csv", "excel"], "structured"),
    (["json", "xml"], "semi-structured"),
    (["table", "database"], "structured"),
    (["text", "log"], "unstructured"),
]

DATA_FORMATS = [
    ("csv", "csv"),
    ("json", "json"),
    ("parquet", "parquet"),
    ("avro", "avro"),
    ("orc", "orc"),
    ("excel", "excel"),
    ("xml", "xml"),
    ("yaml", "yaml"),
    ("table", "sql_table"),
    ("view", "sql_view"),
]

HIGH_VALUE_WORDS = ["customer", "transaction", "financial", "revenue", "sales"]
MEDIUM_VALUE_WORDS = ["user", "product", "inventory", "log", "event"]
COMPRESSED_MARKS = [".gz", ".zip", ".bz2", ".lz4"]
PARTITION_MARKS = ["year=", "month=", "day=", "partition"]

# --- masking and personal data ---------------------------------------------

SENSITIVE_KEYS = ["password", "secret", "key", "token", "credentials", "auth"]

PII_VALUE_PATTERNS = {
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "phone": r"(\+\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}",
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "credit_card": r"\b\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}\b",
    "ip_address": r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b",
}

SENSITIVE_COLUMN_PATTERNS = [
    ".*password.*",
    ".*pwd.*",
    ".*pass.*",
    ".*ssn.*",
    ".*social.*security.*",
    ".*credit.*card.*",
    ".*cc.*number.*",
    ".*account.*number.*",
    ".*routing.*number.*",
    ".*tax.*id.*",
    ".*ein.*",
    ".*api.*key.*",
    ".*secret.*",
    ".*token.*",
]

PII_CATEGORIES = [
    ("Email Address", ["email", "e_mail", "mail"]),
    ("Phone Number", ["phone", "mobile", "tel", "contact"]),
    ("Personal Name", ["name", "first_name", "last_name", "full_name", "firstname", "lastname"]),
    ("Address", ["address", "street", "city", "zip", "postal", "location"]),
    ("Government ID", ["ssn", "social_security", "passport", "license", "id_number"]),
    ("Financial Data", ["credit_card", "account_number", "bank", "iban", "routing"]),
    ("Date of Birth", ["birth", "dob", "birthday", "born"]),
    ("IP Address", ["ip_address", "ip", "client_ip"]),
    ("User Identifier", ["user_id", "customer_id", "client_id"]),
]

PII_RISKS = [
    ("High", "email", ["email", "e_mail", "mail_address"]),
    ("High", "phone", ["phone", "mobile", "telephone", "contact_number"]),
    ("High", "ssn", ["ssn", "social_security", "national_id"]),
    ("High", "address", ["address", "street", "city", "zip", "postal"]),
    ("High", "name", ["first_name", "last_name", "full_name", "customer_name"]),
    ("Medium", "user_id", ["user_id", "customer_id", "client_id"]),
    ("Medium", "ip", ["ip_address", "ip", "client_ip"]),
    ("Medium", "birth", ["birth_date", "dob", "birthday", "age"]),
    ("Low", "preferences", ["preference", "setting", "option"]),
    ("Low", "activity", ["last_login", "activity", "session"]),
]

# --- quality ----------------------------------------------------------------

CONSISTENT_NAME = "^[a-zA-Z][a-zA-Z0-9_]*$"
FRESHNESS_STEPS = [(1, 1.0), (7, 0.9), (30, 0.7), (90, 0.5)]
GLOSSARY_WORDS = [
    ["id", "key", "code", "number"],
    ["name", "title", "description"],
    ["date", "time", "created", "updated"],
]
SCHEMA_TAGS = [
    ("email", "email-data"),
    ("phone", "phone-data"),
    ("address", "address-data"),
    ("id", "identifier-data"),
    ("date", "temporal-data"),
]

# --- business metadata --------------------------------------------------------

SIMPLE_DOMAINS = [
    ("finance", ["finance", "financial", "payment", "transaction", "invoice", "billing", "accounting"]),
    ("hr", ["hr", "human", "employee", "staff", "payroll", "personnel"]),
    ("sales", ["sales", "customer", "crm", "lead", "opportunity", "revenue"]),
    ("marketing", ["marketing", "campaign", "promotion", "advertisement", "social"]),
    ("operations", ["operations", "inventory", "supply", "logistics", "warehouse"]),
    ("analytics", ["analytics", "report", "dashboard", "metric", "kpi", "analysis"]),
]

DOMAINS = [
    ("Customer Management", ["customer", "client", "user", "account", "member", "subscriber"]),
    ("Privacy & Compliance", ["consent", "privacy", "gdpr", "compliance", "opt", "permission"]),
    (
        "Financial Services",
        ["transaction", "payment", "financial", "billing", "invoice", "money", "bank", "credit", "debit"],
    ),
    ("Product Management", ["product", "inventory", "catalog", "merchandise", "item", "sku"]),
    ("Sales & Revenue", ["order", "sales", "revenue", "purchase", "deal", "opportunity"]),
    ("Marketing", ["marketing", "campaign", "promotion", "advertisement", "lead", "prospect"]),
    ("Analytics & Reporting", ["analytics", "reporting", "dashboard", "metrics", "kpi", "statistics"]),
    ("Security & Audit", ["audit", "log", "security", "monitoring", "access", "permission"]),
    ("HR & Employee", ["employee", "hr", "staff", "personnel", "payroll", "benefits"]),
    ("Operations", ["operation", "process", "workflow", "task", "activity", "procedure"]),
]
DEFAULT_DOMAIN = "General Business Data"

RETENTION = {
    "Customer Management": "5 years (Customer lifecycle)",
    "Privacy & Compliance": "7 years (Compliance requirement)",
    "Financial Services": "10 years (Financial regulations)",
    "Security & Audit": "7 years (Audit requirements)",
    "HR & Employee": "7 years (Employment law)",
}
DEFAULT_RETENTION = "3 years (Standard business)"

PROCESSES = {
    "Customer Management": [
        "Customer Onboarding",
        "Customer Support",
        "Customer Retention",
        "Customer Analytics",
    ],
    "Privacy & Compliance": [
        "Consent Management",
        "Data Privacy Review",
        "Compliance Monitoring",
        "Data Subject Requests",
    ],
    "Financial Services": [
        "Payment Processing",
        "Financial Reporting",
        "Risk Management",
        "Transaction Monitoring",
    ],
    "Product Management": [
        "Product Catalog Management",
        "Inventory Management",
        "Product Development",
        "Pricing Strategy",
    ],
    "Sales & Revenue": ["Order Processing", "Sales Pipeline", "Revenue Recognition", "Customer Acquisition"],
    "Marketing": ["Campaign Management", "Lead Generation", "Marketing Analytics", "Customer Segmentation"],
    "Analytics & Reporting": [
        "Business Intelligence",
        "Performance Monitoring",
        "Strategic Planning",
        "Data Visualization",
    ],
    "Security & Audit": [
        "Security Monitoring",
        "Compliance Auditing",
        "Risk Assessment",
        "Access Management",
    ],
    "HR & Employee": [
        "Employee Onboarding",
        "Payroll Processing",
        "Performance Management",
        "Benefits Administration",
    ],
    "Operations": [
        "Process Optimization",
        "Workflow Management",
        "Quality Control",
        "Operational Analytics",
    ],
}
DEFAULT_PROCESSES = ["Data Management", "Business Operations", "System Integration"]

HEAVY_USE_WORDS = ["master", "core", "primary", "main", "central", "reference"]
PCI_WORDS = ["payment", "credit", "debit", "transaction", "billing"]
HIPAA_WORDS = ["health", "medical", "patient", "diagnosis"]
SOX_WORDS = ["bank", "financial", "investment", "securities"]

# --- lineage ------------------------------------------------------------------

LINEAGE_WORDS = [
    "customer",
    "order",
    "transaction",
    "account",
    "user",
    "product",
    "sales",
    "client",
    "employee",
    "banking",
    "loan",
    "card",
]
UPSTREAM_WORDS = ["raw", "source", "input", "base", "staging", "landing"]
UPSTREAM_TARGET_WORDS = ["agg", "summary", "mart"]
DOWNSTREAM_WORDS = ["processed", "output", "mart", "agg", "summary", "report", "analytics"]
DOWNSTREAM_TARGET_WORDS = ["raw", "base", "source"]
MODEL_WORDS = ["master", "dim", "fact", "cube"]

COLUMN_TOPIC_WORDS = ["customer", "user", "account", "order", "transaction"]
DIRECTION_RELATED_WORDS = ["raw", "source", "base", "landing", "staging"]
DIRECTION_TARGET_WORDS = ["mart", "agg", "summary", "report"]

HINT_WORDS = ["etl", "transform", "process", "clean", "stage", "raw", "curated"]
ARCHIVE_WORDS = ["backup", "archive", "historical"]
FREQUENCY_WORDS = ["daily", "hourly", "weekly", "monthly"]

EDGE_TEXTS = {
    "derived_from": "{t} is derived from {s} through data transformation",
    "transforms_to": "{s} transforms data to create {t}",
    "aggregates_to": "{s} aggregates data to produce {t}",
    "joins_with": "{s} joins with other sources to create {t}",
    "filters_to": "{s} applies filtering logic to create {t}",
    "enriches_to": "{s} enriches data to create {t}",
}

NAME_TRANSFORMATIONS = [
    (["agg", "summary", "total"], "aggregation", "Data aggregation based on naming pattern", 0.75),
    (["clean", "processed", "refined"], "data_processing", "Data processing and refinement", 0.78),
    (
        ["mart", "dim_", "fact_"],
        "dimensional_modeling",
        "Dimensional modeling transformation for analytics",
        0.82,
    ),
]

# --- connectors -----------------------------------------------------------------

CONNECTOR_CATEGORIES = [
    "cloud_providers",
    "databases",
    "data_warehouses",
    "network_storage",
    "streaming",
    "data_lakes",
    "network",
    "file_systems",
]
