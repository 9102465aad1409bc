"""Word lists, lookup tables, constants and patterns whose content results depend on."""

from __future__ import annotations

# --- URLs (fixed values) ---
TRACKING_PARAMS = [
    "utm_source", "utm_medium", "utm_campaign", "utm_content", "utm_term", "utm_id", "gclid", "fbclid", "msclkid", "dclid", "twclid",
    "refId", "trackingId", "trk", "trkCode", "original_referer",
    "from", "vjs", "advn", "vjfrom", "rref", "tk", "acatk", "pub",
    "sid",
    "ref", "source", "campaign", "medium",
]
SOURCE_HOSTS = {
    "linkedin.com": "linkedin", "indeed.com": "indeed", "naukri.com": "naukri", "cutshort.io": "cutshort",
    "instahyre.com": "instahyre", "hirist.tech": "hirist", "wellfound.com": "wellfound", "hirect.in": "hirect",
}
#: Domain that scopes a search to a source.
SOURCE_SCOPES = {
    "linkedin": "linkedin.com/jobs", "indeed": "indeed.com", "naukri": "naukri.com", "cutshort": "cutshort.io",
    "instahyre": "instahyre.com", "hirist": "hirist.tech", "wellfound": "wellfound.com", "hirect": "hirect.in",
}
SOURCES = list(SOURCE_SCOPES)
LINKEDIN_STRIPPED = ["refId", "trackingId", "trk", "position", "pageNum", "utm_source", "utm_medium", "utm_campaign", "original_referer"]
LINKEDIN_PATHS = [r"linkedin\.com/jobs/view/(\d+)", r"linkedin\.com/jobs/collections/[^/]+/\?.*currentJobId=(\d+)", r"linkedin\.com/job/[^/]+-(\d+)"]
INDEED_KEY = r"\bjk=([a-f0-9]+)"
NAUKRI_IDS = [r"[?&]jid=(\d+)", r"-(\d{6,})(?:\?|$|/)"]
CUTSHORT_ID = r"/(?:job|jobs)/[^/]*?-?(\w{8,})"
INSTAHYRE_ID = r"/job-(\d+)"
HIRIST_ID = r"/j/[^/]*?-(\d+)"
WELLFOUND_IDS = [r"/l/[^/]+/(\d+)", r"/jobs/(\d+)"]
HIRECT_ID = r"/job(?:s)?/([\w-]+)"

# --- Locations (fixed values) ---
STATES = {
    "AN": "Andaman and Nicobar Islands", "AP": "Andhra Pradesh", "AR": "Arunachal Pradesh", "AS": "Assam", "BR": "Bihar", "CG": "Chhattisgarh",
    "CH": "Chandigarh", "DD": "Daman and Diu", "DL": "Delhi", "DN": "Dadra and Nagar Haveli", "GA": "Goa", "GJ": "Gujarat", "HP": "Himachal Pradesh",
    "HR": "Haryana", "JH": "Jharkhand", "JK": "Jammu and Kashmir", "KA": "Karnataka", "KL": "Kerala", "LA": "Ladakh", "LD": "Lakshadweep",
    "MH": "Maharashtra", "ML": "Meghalaya", "MN": "Manipur", "MP": "Madhya Pradesh", "MZ": "Mizoram", "NL": "Nagaland", "OR": "Odisha", "OD": "Odisha",
    "PB": "Punjab", "PY": "Puducherry", "RJ": "Rajasthan", "SK": "Sikkim", "TG": "Telangana", "TS": "Telangana", "TN": "Tamil Nadu", "TR": "Tripura",
    "UK": "Uttarakhand", "UP": "Uttar Pradesh", "WB": "West Bengal",
}
#: City in lower case to its state; the country is always COUNTRY.
CITIES = {
    "bangalore": "Karnataka", "bengaluru": "Karnataka", "mumbai": "Maharashtra", "pune": "Maharashtra", "delhi": "Delhi", "new delhi": "Delhi",
    "gurgaon": "Haryana", "gurugram": "Haryana", "noida": "Uttar Pradesh", "hyderabad": "Telangana", "secunderabad": "Telangana",
    "chennai": "Tamil Nadu", "coimbatore": "Tamil Nadu", "madurai": "Tamil Nadu", "kolkata": "West Bengal", "ahmedabad": "Gujarat",
    "surat": "Gujarat", "vadodara": "Gujarat", "jaipur": "Rajasthan", "kochi": "Kerala", "thiruvananthapuram": "Kerala", "trivandrum": "Kerala",
    "chandigarh": "Punjab", "bhopal": "Madhya Pradesh", "indore": "Madhya Pradesh", "nagpur": "Maharashtra", "lucknow": "Uttar Pradesh",
    "visakhapatnam": "Andhra Pradesh", "vizag": "Andhra Pradesh", "patna": "Bihar", "ranchi": "Jharkhand",
}
COUNTRY = "India"
REMOTE = r"\b(remote|work\s+from\s+home|wfh|anywhere|pan\s+india)\b"

# --- Salaries (fixed values) ---
ANNUAL = r"\b(lpa|l\.p\.a\.|l\s*p\s*a|per\s+annum|p\.a\.|annual(?:ly)?|yearly)\b"
MONTHLY = r"\b(per\s+month|/month|monthly|p\.m\.)\b"
HOURLY = r"\b(per\s+hour|/hour|hourly)\b"
SALARY_NOISE = r"\b(lpa|l\.p\.a\.|l\s*p\s*a|per\s+annum|annual(?:ly)?|yearly|per\s+month|/month|monthly|per\s+hour|/hour|hourly|inr|rupees?|rs\.?|p\.a\.|p\.m\.)\b"
RANGE = r"\s*[-–—]+\s*|\s+to\s+"
AMOUNT = r"([\d,]+(?:\.\d+)?)\s*(lpa|l\.p\.a\.|lakh(?:s)?|lac|crore|cr|k|m)?"
UNIT = r"\b(lpa|l\.p\.a\.|lakh(?:s)?|lac|crore|cr|k|m)\b"
UNIT_VALUE = {"lpa": 1e5, "l.p.a.": 1e5, "lakh": 1e5, "lac": 1e5, "crore": 1e7, "cr": 1e7, "k": 1e3, "m": 1e6}

# --- Skills: alias to canonical name (fixed values) ---
SKILLS = {
    "ml": "Machine Learning", "machine learning": "Machine Learning", "machine-learning": "Machine Learning", "deep learning": "Deep Learning",
    "dl": "Deep Learning", "deep-learning": "Deep Learning", "natural language processing": "NLP", "nlp": "NLP", "computer vision": "Computer Vision",
    "cv": "Computer Vision", "ai": "Artificial Intelligence", "artificial intelligence": "Artificial Intelligence", "llm": "LLM",
    "large language model": "LLM", "generative ai": "Generative AI", "gen ai": "Generative AI",
    "python": "Python", "python3": "Python", "java": "Java", "javascript": "JavaScript", "js": "JavaScript", "typescript": "TypeScript",
    "ts": "TypeScript", "golang": "Go", "go": "Go", "rust": "Rust", "c++": "C++", "c plus plus": "C++", "cplusplus": "C++", "c#": "C#", "csharp": "C#",
    "dotnet": ".NET", ".net": ".NET", "ruby": "Ruby", "php": "PHP", "scala": "Scala", "kotlin": "Kotlin", "swift": "Swift", "r": "R",
    "react": "React", "reactjs": "React", "react.js": "React", "angular": "Angular", "angularjs": "Angular", "vue": "Vue.js", "vuejs": "Vue.js",
    "vue.js": "Vue.js", "node": "Node.js", "nodejs": "Node.js", "node.js": "Node.js", "django": "Django", "flask": "Flask", "fastapi": "FastAPI",
    "spring": "Spring", "spring boot": "Spring Boot", "springboot": "Spring Boot", "rails": "Ruby on Rails", "ruby on rails": "Ruby on Rails",
    "express": "Express.js", "expressjs": "Express.js", "laravel": "Laravel", "nextjs": "Next.js", "next.js": "Next.js",
    "postgres": "PostgreSQL", "postgresql": "PostgreSQL", "mysql": "MySQL", "mongodb": "MongoDB", "mongo": "MongoDB", "redis": "Redis",
    "elasticsearch": "Elasticsearch", "elastic search": "Elasticsearch", "cassandra": "Cassandra", "sqlite": "SQLite", "mssql": "SQL Server",
    "sql server": "SQL Server", "oracle": "Oracle DB", "oracle db": "Oracle DB", "dynamodb": "DynamoDB", "neo4j": "Neo4j", "clickhouse": "ClickHouse",
    "aws": "AWS", "amazon web services": "AWS", "azure": "Azure", "microsoft azure": "Azure", "gcp": "GCP", "google cloud": "GCP",
    "google cloud platform": "GCP",
    "docker": "Docker", "kubernetes": "Kubernetes", "k8s": "Kubernetes", "terraform": "Terraform", "ansible": "Ansible", "jenkins": "Jenkins",
    "github actions": "GitHub Actions", "ci/cd": "CI/CD", "cicd": "CI/CD", "devops": "DevOps", "sre": "SRE", "linux": "Linux", "unix": "Unix",
    "bash": "Bash", "shell scripting": "Shell Scripting", "git": "Git",
    "sql": "SQL", "spark": "Apache Spark", "apache spark": "Apache Spark", "hadoop": "Hadoop", "kafka": "Apache Kafka", "apache kafka": "Apache Kafka",
    "airflow": "Apache Airflow", "apache airflow": "Apache Airflow", "pandas": "Pandas", "numpy": "NumPy", "scikit-learn": "scikit-learn",
    "sklearn": "scikit-learn", "tensorflow": "TensorFlow", "tf": "TensorFlow", "pytorch": "PyTorch", "torch": "PyTorch",
    "huggingface": "Hugging Face", "hugging face": "Hugging Face", "powerbi": "Power BI", "power bi": "Power BI", "tableau": "Tableau", "looker": "Looker",
    "agile": "Agile", "scrum": "Scrum", "rest": "REST", "restful": "REST", "rest api": "REST", "graphql": "GraphQL", "microservices": "Microservices",
    "tdd": "TDD", "test driven development": "TDD", "bdd": "BDD", "oop": "OOP", "object oriented programming": "OOP", "object-oriented": "OOP",
}

# --- Page text (fixed values) ---
NOISE_TAGS = ["script", "style", "noscript", "header", "footer", "nav", "aside", "iframe", "svg", "button", "form"]
SALARY_TEXT = (
    r"(₹\s?[\d,]+(?:\.\d+)?\s*(?:LPA|L\.P\.A\.|lakh|lakhs|k|/month|/yr|/year|per\s+annum)?"
    r"(?:\s*[-–—to]+\s*₹?\s*[\d,]+(?:\.\d+)?\s*(?:LPA|L\.P\.A\.|lakh|lakhs|k|/month|/yr|/year|per\s+annum)?)?)"
    r"|(\d+(?:\.\d+)?\s*[-–—to]+\s*\d+(?:\.\d+)?\s*LPA)|(INR\s*[\d,]+(?:\.\d+)?(?:\s*[-–—to]+\s*INR?\s*[\d,]+(?:\.\d+)?)?)"
)
EXPERIENCE_TEXT = r"(\d+(?:\.\d+)?\s*[-–—+]\s*\d+(?:\.\d+)?\s*(?:years?|yrs?)\s*(?:of\s+)?(?:experience)?)|(\d+\+?\s*(?:years?|yrs?)\s*(?:of\s+)?(?:experience)?)"
EMPLOYMENT_TEXT = r"\b(full[- ]time|part[- ]time|contract|freelance|intern(ship)?|temporary|permanent)\b"
WORK_MODE_TEXT = r"\b(remote|work\s+from\s+home|wfh|hybrid|on[- ]?site|in[- ]?office)\b"
POSTED_TEXT = (
    r"(?:posted|published|listed)\s*(?:on|:)?\s*((?:\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4})"
    r"|(?:\d{1,2}\s+(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\w*\s+\d{4})|(?:\d+\s+(?:day|hour|minute|week)s?\s+ago))"
)
EMAIL_TEXT = r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+"
APPLY_URL_TEXT = r"(?:apply|application)\s+(?:here|now|at|url|link)?[:\s]*(https?://[^\s\"'<>]+)"
NOT_TITLE = r"(login|sign in|register|home|menu|search)"
COMPANY_LABEL = r"(?:company|employer|organization|organisation)\s*[:\-]\s*(.+)"
COMPANY_AT = r"at\s+([A-Z][A-Za-z\s&.,]+?)(?:\s+we\b|\s+is\b|\.|,)"
LOCATION_LABEL = r"(?:location|place|city|office)\s*[:\-]\s*([^\n]+)"
LOCATION_CITY = (
    r"\b((?:Bangalore|Bengaluru|Mumbai|Delhi|Chennai|Hyderabad|Pune|Kolkata|Noida|Gurgaon|Gurugram|Ahmedabad|Jaipur|Kochi|Coimbatore|Chandigarh|"
    r"Indore|Bhopal|Nagpur|Lucknow|Visakhapatnam|Surat|Vadodara|Thiruvananthapuram)(?:\s*,\s*(?:TN|MH|DL|KA|TS|AP|GJ|RJ|UP|WB|Punjab|Maharashtra|Tamil Nadu|"
    r"Karnataka|Telangana|Andhra Pradesh|Gujarat|Rajasthan))?)"
)
BULLET = r"^[•\-*·>–\d]+[.)]\s*"
#: Section label to the headings that open it; the first label that matches wins.
HEADINGS = {
    "preferred_qualifications": [
        r"^preferred\s+(qualifications?|skills?|requirements?)\s*$", r"^(nice[\s\-]to[\s\-]have|good[\s\-]to[\s\-]have|bonus\s+skills?|additional\s+(qualifications?|skills?))\s*$",
        r"^(preferred|bonus|plus)\s*$", r"would\s+be\s+(an?\s+)?advantage",
    ],
    "responsibilities": [
        r"^(key\s+)?responsibilit(y|ies)\s*$", r"^what\s+you.ll\s+do\s*$", r"^your\s+role\s*$", r"^day[- ]to[- ]day\s*$", r"^job\s+duties\s*$",
        r"^duties\s+and\s+responsibilities\s*$",
    ],
    "requirements": [
        r"^(required|minimum|must[\s\-]have)\s+(qualifications?|skills?|requirements?)\s*$", r"^requirements?\s*$", r"^qualifications?\s*$",
        r"^what\s+we.re?\s+looking\s+for\s*$", r"^you\s+should\s+have\s*$", r"^(skills?\s+(required|needed|we\s+need))\s*$",
    ],
    "benefits": [
        r"^benefits?\s*$", r"^perks?\s*$", r"^what\s+we\s+offer\s*$", r"^why\s+(join|work\s+(at|with|for))\s*", r"^compensation\s+and\s+benefits\s*$",
        r"^what.s\s+in\s+it\s+for\s+you\s*$",
    ],
    "description": [
        r"^about\s+the\s+(role|job|position|opportunity)\s*$", r"^(job|role|position)\s+(overview|summary|description)\s*$", r"^overview\s*$",
        r"^about\s+(us|the\s+company|techcorp|our\s+company)\s*$",
    ],
    "salary": [r"^(salary|compensation|ctc|pay|package|remuneration)\s*$"],
    "application": [r"^(how\s+to\s+apply|apply\s+now|application\s+(process|instructions?))\s*$"],
}
HEADING_LENGTH = 80

# --- Search queries (fixed values) ---
TITLE_SYNONYMS = {
    "developer": ["developer", "engineer", "programmer"], "engineer": ["engineer", "developer"], "scientist": ["scientist", "analyst", "researcher"],
    "analyst": ["analyst", "specialist"], "manager": ["manager", "lead", "head"], "designer": ["designer", "ux", "ui"],
    "devops": ["devops", "sre", "platform engineer"], "qa": ["qa", "quality assurance", "test engineer", "sdet"],
    "fullstack": ["fullstack", "full stack", "full-stack"], "frontend": ["frontend", "front-end", "ui developer"],
    "backend": ["backend", "back-end", "server-side"], "data": ["data", "analytics"], "ml": ["ml", "machine learning", "ai"],
}
TECH = (
    r"^(python|java|javascript|typescript|react|angular|vue|node|go|rust|ruby|scala|kotlin|swift|c\+\+|c#|dotnet|\.net|php|aws|azure|gcp|"
    r"devops|sre|data|ml|ai|android|ios|flutter|django|spring|fastapi|rails)"
)
DEFAULT_TITLE = "software engineer"

# --- Scoring and validation (fixed values) ---
WEIGHTS = {"title": 0.40, "location": 0.20, "experience": 0.20, "workplace": 0.10, "freshness": 0.10}
FRESH_DAYS = 90
STOP_WORDS = ["the", "and", "for", "with", "at", "to", "of", "in", "a", "an"]
#: Field, weight, required.
COMPLETENESS = [
    ("canonical_url", 0.10, True), ("source", 0.05, True), ("retrieval_timestamp", 0.05, True), ("title", 0.15, True), ("description", 0.10, True),
    ("company", 0.10, False), ("location", 0.08, False), ("requirements", 0.08, False), ("salary", 0.06, False), ("employment_type", 0.05, False),
    ("work_mode", 0.05, False), ("experience", 0.05, False), ("application", 0.05, False), ("raw_content", 0.08, False), ("content_hash", 0.05, False),
]
URL_FORMAT = r"^https?://[^\s/$.?#].[^\s]*$"
EMAIL_FORMAT = r"^[^\s@]+@[^\s@]+\.[^\s@]+$"
HASH_FORMAT = r"^[0-9a-f]{64}$"
EMPLOYMENT_TYPES = ["full-time", "part-time", "contract", "internship", "temporary", "permanent", "freelance"]
WORK_MODES = ["remote", "hybrid", "onsite", "on-site", "in-office"]
LIFECYCLES = ["active", "expired", "removed", "unknown", "unavailable"]
RETRYABLE = [429, 500, 502, 503, 504]
PERMANENT = [400, 401, 403, 404, 410]
PROCESSED = ["fetched", "stored", "duplicate", "fetch_skipped", "extraction_done"]
CHANGE_FIELDS = [
    "title", "location", "salary_raw", "experience_raw", "employment_type", "work_mode", "description_text", "responsibilities", "requirements_text", "required_skills", "preferred_skills",
]
HEALTH_FIELDS = ["title", "company", "location", "description", "experience", "salary", "employment_type"]

# --- Export (fixed values) ---
EXPORT_COLUMNS = [
    ("Job Title", 30, "title"), ("Company", 25, "company"), ("Location", 20, "location"), ("Workplace Type", 18, "work_mode"), ("Experience", 18, "experience"),
    ("Salary (raw)", 20, "salary_raw"), ("Skills", 35, "skills"), ("Posted Date", 16, "posted_date"), ("Employment Type", 18, "employment_type"), ("Source", 15, "source"),
    ("Job URL", 50, "job_url"), ("Application URL", 40, "apply_url"), ("Job ID", 50, "job_id"), ("Search Run ID", 22, "run_id"), ("First Seen", 22, "first_seen_at"),
    ("Last Seen", 22, "last_seen_at"), ("Version", 10, "version"), ("Validation Status", 20, "validation_status"), ("Job Status", 18, "lifecycle_status"),
]
EMPTY_CELLS = ["", "null", "none", "n/a"]
