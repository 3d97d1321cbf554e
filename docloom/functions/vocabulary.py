"""Word lists, patterns and labels that results depend on."""

# --- characters and years in texts (fixed values) ---
WHITE_SPACE = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
PICTURES = r"[\x{1F300}-\x{1FAFF}\u2600-\u27bf\u2300-\u23ff\u2b00-\u2bff\p{So}\p{Sk}]"
JOINED_YEARS = r"\b(20\d{2})(20\d{2})\b"

# --- keywords (fixed values) ---
KEYWORD_STOP_WORDS = """
the is a an and or of to in for on at by with from this that are was were be as it has have had not only but also
than into their there then them they you your which who what when where how will would could should can may might
shall must been being do does did done get got let make made during through within under after before between about
against over such any each every all both more most some other another same very just here letter document details
information section page number date name email phone company pvt ltd private limited add added adding use used using
run runs running install installed create created creating include included including check checked checking work works
working start started starting open opened openning version command commands output result example examples step steps
note notes type types file files folder folders line lines com www http https
""".split()
TECHNICAL_TERMS = [
    "python", "pip", "venv", "virtualenv", "requirements", "requirements.txt", "github", "git", "docker", "flask", "fastapi",
    "django", "sql", "mysql", "postgresql", "sqlite", "mongodb", "firebase", "tensorflow", "keras", "pytorch", "scikit-learn",
    "numpy", "pandas", "matplotlib", "seaborn", "plotly", "opencv", "mediapipe", "tesseract", "ocr", "nlp", "llm",
    "machine-learning", "machine learning", "deep-learning", "deep learning", "artificial-intelligence",
    "artificial intelligence", "data-science", "data science", "environment", "deployment", "testing", "logging",
    "reproducibility", "api", "rest", "backend", "frontend", "streamlit",
]
GENERIC_WORDS = ["project", "system", "process", "content", "basic", "important", "different", "general"]

KEYWORD_TOKEN = r"\b[a-zA-Z][a-zA-Z0-9_.-]{2,}\b"
KEYWORD_EDGES = r"^[.,;:!?()\[\]{}<>\"'`]+|[.,;:!?()\[\]{}<>\"'`]+$"
PHRASE_TOKEN = r"\b[a-zA-Z][a-zA-Z0-9_-]{2,}\b"

# --- information record (fixed values) ---
CONCEPTS = {
    "Python": ["python", "python programming", "python installation"],
    "Virtual Environments": ["venv", "virtual environment", "virtual environments", "virtualenv", "conda"],
    "Package Management": ["pip", "package management", "package-management"],
    "Requirements & Reproducibility": ["requirements.txt", "requirements file", "reproducibility", "dependencies"],
    "Git & GitHub": ["git", "github", "version control", "git repository"],
    "Environment Variables & Secrets": ["environment variables", "environment variable", ".env", "secrets", "api keys", "api key"],
    "Jupyter & VS Code": ["jupyter", "jupyterlab", "jupyter notebook", "vs code", "visual studio code"],
    "Cloud Fundamentals": ["cloud", "cloud fundamentals", "compute", "storage", "networking", "dns", "https", "tls", "object storage", "serverless"],
    "Deployment": ["deployment", "deploy", "deploying", "production"],
    "Docker": ["docker", "dockerfile", "container", "containerize", "containerized"],
    "Testing": ["testing", "test", "unit testing", "ml testing"],
    "Logging & Debugging": ["logging", "debugging", "troubleshooting", "debug", "traceback"],
    "Data Science": ["data science", "data analysis", "data visualization"],
    "Machine Learning": ["machine learning", "classical ml", "ml"],
    "Deep Learning": ["deep learning", "deep-learning", "tensorflow", "keras", "pytorch"],
    "Computer Vision": ["computer vision", "opencv", "pillow", "mediapipe", "cv"],
    "NLP": ["nlp", "natural language processing", "spacy", "nltk"],
    "Generative AI / LLM": ["genai", "generative ai", "llm", "large language model"],
    "RAG & AI Agents": ["rag", "retrieval augmented generation", "ai agents", "agents"],
    "Backend & APIs": ["backend", "api", "rest api", "flask", "fastapi"],
    "Database": ["database", "dbms", "sql", "mysql", "postgresql", "sqlite", "mongodb"],
    "Model Reproducibility": ["dataset reproducibility", "model reproducibility", "random seeds", "evaluation metrics"],
    "Security": ["security", "credentials", "private credentials", "secret exposure"],
}
SECTIONS = {
    "Python Installation": [r"\bpython installation\b", r"\binstall python\b"],
    "Virtual Environments": [r"\bvirtual environments?\b", r"\bvenv\b", r"\bconda\b"],
    "Package Management": [r"\bpip\b", r"\bpackage management\b"],
    "Git & GitHub": [r"\bgit\b", r"\bgithub\b", r"\bversion control\b"],
    "Cloud Fundamentals": [r"\bcloud fundamentals\b", r"\bcloud architecture\b"],
    "Deployment": [r"\bdeployment\b", r"\bdeploy\b"],
    "Docker": [r"\bdocker\b", r"\bdockerfile\b"],
    "Testing": [r"\btesting basics\b", r"\btesting\b"],
    "Logging & Debugging": [r"\blogging\b", r"\bdebugging\b", r"\btroubleshooting\b"],
    "Reproducibility": [r"\breproducibility\b", r"\breproducible\b"],
    "AI / DS / ML Topic Audit": [r"\btopic audit\b", r"\bai/ds/ml\b", r"\bai/.+ml topic audit\b"],
}
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
PLACEHOLDER_EMAILS = ["you@example.com", "example@example.com"]
PHONE = r"\b(?:\+91[\s-]?)?[6-9]\d{9}\b"
# stricter forms, as options
PHONE_STRICT = r"(?<![\w+])(?:\+91[\s-]?)?[6-9]\d{9}\b"
CURRENCY_STRICT = [r"₹\s?\d[\d,]*(?:\.\d+)?", r"\bRs\.?\s?\d[\d,]*(?:\.\d+)?", r"\bINR\s?\d[\d,]*(?:\.\d+)?"]
BULLET_STRICT = r"^(?:[-*•]|\d+[.)])\s+"
URL = r"https?://[^\s]+"
DATE = r"\b\d{1,2}[./-]\d{1,2}[./-]\d{2,4}\b"
CURRENCY = [r"₹\s?[\d,]+(?:\.\d+)?", r"\bRs\.?\s?[\d,]+(?:\.\d+)?", r"\bINR\s?[\d,]+(?:\.\d+)?"]
COMMANDS = [
    r"python\s+-m\s+pip\s+[^\n]+", r"python\s+-m\s+venv\s+[^\n]+", r"python\s+--version", r"python3\s+--version",
    r"pip\s+--version", r"pip\s+install\s+[^\n]+", r"git\s+(?:init|status|add|commit|push|pull|branch|switch)[^\n]*",
    r"jupyter\s+lab", r"conda\s+(?:create|activate|deactivate)[^\n]*",
]
MOST_COMMANDS = 15
PAGE_MARK = r"---\s*Page\s+(\d+)\s*---"
TABLE_MARK = r"\[TABLE\s+(\d+)\]"
NOTHING_FOUND = "No significant structured information detected."

# --- summaries (fixed values) ---
SUMMARY_STOP_WORDS = """
the a an and or but if then than this that these those with without from for into onto about over under between through
during before after while where when which who whom whose what why how is are was were be been being has have had do does
did can could should would may might must will shall to of in on at by as it its their there they them you your we our i
me my he she his her also very more most some any all each every both only just such not no yes using used use uses one
two three first second third etc example examples
""".split()
TOPICS = [
    "Python", "Virtual Environments", "Package Management", "pip", "requirements.txt", "Git", "GitHub",
    "Environment Variables", "Secrets", "Jupyter", "VS Code", "Cloud Fundamentals", "Deployment", "Docker", "Testing",
    "Logging", "Debugging", "Reproducibility", "Data Science", "Machine Learning", "Deep Learning", "Computer Vision", "NLP",
    "Generative AI", "LLM", "RAG", "AI Agents", "Backend", "APIs", "Database", "Security",
]
CV_TERMS = [
    "resume", "curriculum vitae", "education", "work experience", "experience", "professional experience", "skills",
    "technical skills", "projects", "certifications", "achievements", "additional information", "availability", "linkedin",
    "github", "portfolio", "vfx", "matchmove", "rotomation", "animation", "internship", "full-time", "fulltime", "candidate",
]
CV_STRONG = ["work experience", "education", "certifications", "technical skills", "linkedin", "github", "portfolio"]
STRUCTURAL = [
    r"\[TABLE\s*\d+\]", r"\btable\s*\d+\b", r"\btopic\s*\|\s*status\s*\|\s*role\b", r"\barea\s*\|\s*typical tools\b",
    r"\bconcept\s*\|\s*simple meaning\b", r"\blayer\s*\|\s*coverage\b", r"\bproblem\s*\|\s*first checks\b",
    r"\btypical tools\b", r"\bsimple meaning\b", r"\bfirst checks\b", r"\bstatus\s*\|\s*role\b",
]
COMMAND_LINE = r"^(?:\$|(?:python|python3|pip|git|docker|cd|mkdir|rm|copy|set|export|conda|npm|uv|source|jupyter)\s)"
TABLE_HEADERS = [r"Topic\s*\|\s*Status\s*\|\s*Role", r"Area\s*\|\s*Typical tools", r"Concept\s*\|\s*Simple meaning", r"Layer\s*\|\s*Coverage", r"Problem\s*\|\s*First checks"]
NOISE_STARTS = [
    "one-page memory map", "memory map", "practice checklist", "quick reference", "table of contents", "contents", "page ",
    "chapter ", "section ", "final gap audit", "core ai/ds package stack", "final ai/ds/ml topic audit",
    "python installation environments", "production basics",
]
TITLE_PHRASES = ["master book", "practical setup & missing topics", "production basics purpose", "python installation environments git cloud"]
VERBS = [
    "is", "are", "was", "were", "provides", "explains", "records", "helps", "allows", "requires", "prevents", "recommends",
    "covers", "focuses", "means", "supports", "isolates", "connects",
]
IMPORTANT = [
    "purpose", "important", "recommended", "production", "deployment", "reproducibility", "security", "workflow",
    "architecture", "testing", "debugging", "environment", "installation", "project", "development", "version", "package",
    "documentation", "practical", "isolate", "dependencies", "repository", "secrets",
]
PURPOSES = {
    "full": "The document provides a practical setup and gap-audit guide for Python, Data Science, Machine Learning and related AI development workflows, with emphasis on reproducibility and production readiness.",
    "learning": "The document provides practical guidance on Data Science and Machine Learning development workflows.",
    "python": "The document provides practical guidance for Python development and project setup.",
    "other": "The document presents practical technical guidance organized around development concepts and workflows.",
}
NO_TEXT = "No meaningful text was available for summarization."
CV_HEADINGS = {
    "summary": ["summary", "profile", "professional summary", "career objective", "objective", "about me"],
    "education": ["education", "academic background", "educational background"],
    "experience": ["work experience", "professional experience", "experience", "employment history", "work history"],
    "projects": ["projects", "personal projects", "academic projects", "key projects", "project experience"],
    "skills": ["skills", "technical skills", "core skills", "skills & technologies", "technical skills & tools"],
    "certifications": ["certifications", "certificates", "licenses & certifications"],
    "achievements": ["achievements", "awards", "accomplishments"],
    "additional": ["additional information", "additional info", "availability", "personal details"],
}
CV_EXPERIENCE = [
    r"\b\d+\+?\s+years?\s+of\s+(?:professional\s+)?(?:vfx|animation|experience)",
    r"\b\d+\+?\s+years?\s+of\s+experience",
    r"\b\d+\+?\s+years?\s+vfx",
]
CV_ACCURACY = [r"\b\d+(?:\.\d+)?%\s*(?:test\s+)?accuracy", r"accuracy\s*[:\-]?\s*\d+(?:\.\d+)?%"]
DEGREE = r"\b(M\.?\s*Sc\.?|M\.?\s*S\.?|MCA|B\.?\s*Sc\.?|B\.?\s*A\.?|B\.?\s*Tech\.?|B\.?\s*E\.?|BCA|Diploma|Ph\.?\s*D\.?)\b"
YEAR_RANGE = r"\b20\d{2}\s*[-–—]\s*(?:20\d{2}|Present)\b"
PROJECT_DETAILS = [
    "selenium,", "streamlit,", "pandas,", "sql,", "plotly,", "tensorflow,", "keras,", "opencv,", "mediapipe,", "python,",
    "test accuracy", "accuracy:", "in progress", "technologies:", "technology:", "tools:", "stack:", "built with",
    "developed using", "used:",
]
TECHNOLOGY_ONLY = [
    "python", "tensorflow", "keras", "opencv", "mediapipe", "streamlit", "pandas", "numpy", "sql", "plotly",
    "machine learning", "deep learning", "computer vision", "data science", "artificial intelligence", "rotomation",
    "matchmove", "animation",
]
PROJECT_WORDS = [
    "classification", "data scraping", "visualizations", "pipeline", "analyzer", "recommendation", "forecast", "drowsiness",
    "dashboard", "prediction", "detection", "recognition", "application", "app",
]
SKILLS = {
    "Python": "python", "C++": "c++", "SQL": "sql", "Pandas": "pandas", "NumPy": "numpy", "Matplotlib": "matplotlib",
    "Scikit-learn": "scikit-learn", "TensorFlow": "tensorflow", "Keras": "keras", "OpenCV": "opencv", "MediaPipe": "mediapipe",
    "Flask": "flask", "Streamlit": "streamlit", "MySQL": "mysql", "TiDB": "tidb", "SQLite": "sqlite", "Firebase": "firebase",
    "Git": "git", "GitHub": "github", "Jupyter": "jupyter", "CNN": "cnn", "RNN": "rnn", "LSTM": "lstm",
}
NOT_NAMES = ["data science", "machine learning", "artificial intelligence", "summary", "education", "skills"]

# --- document types (fixed values) ---
TYPE_WORDS = {
    "CV / Resume": ["education", "work experience", "professional experience", "experience", "skills", "projects", "certifications", "achievements", "linkedin", "github", "portfolio", "resume", "curriculum vitae", "vfx", "matchmove", "rotomation", "internship", "availability", "full-time"],
    "Study Material": ["chapter", "unit", "lesson", "definition", "definitions", "learning objectives", "learning objective", "exam", "question bank", "fill in the blanks", "short answer", "long answer", "notes", "study material", "syllabus", "assignment", "important questions", "key concepts", "concepts"],
    "Report": ["executive summary", "introduction", "methodology", "findings", "results", "discussion", "conclusion", "recommendations", "analysis", "objective", "scope", "report", "observations", "limitations"],
}
TYPE_STRONG = ["linkedin", "github", "portfolio", "resume", "curriculum vitae", "professional experience", "work experience"]

# --- spellings that recognition gets wrong (fixed values): pattern, ignoring case, and replacement ---
MODEL_SPELLINGS = [
    (r"\bScikitlearn\b", "Scikit-learn"), (r"\bScikit learn\b", "Scikit-learn"), (r"\bScik it-learn\b", "Scikit-learn"),
    (r"\bTensor Flow\b", "TensorFlow"), (r"\bTensorflow\b", "TensorFlow"), (r"\bOpen CV\b", "OpenCV"),
    (r"\bMedia Pipe\b", "MediaPipe"), (r"\bStream lit\b", "Streamlit"), (r"\bGithub\b", "GitHub"),
    (r"\bLinkedin\b", "LinkedIn"), (r"\bMysql\b", "MySQL"), (r"\bSqlite\b", "SQLite"), (r"\bTIDB\b", "TiDB"),
    (r"\bFlaskk\b", "Flask"), (r"\bDevelopmentt\b", "Development"), (r"\bAncuracy\b", "Accuracy"),
    (r"\bDats Science\b", "Data Science"), (r"\bfulltime\b", "full-time"), (r"\brealworld\b", "real-world"),
]
SCAN_SPELLINGS = [
    (r"\bScikitlearn\b", "Scikit-learn"), (r"\bScikit learn\b", "Scikit-learn"), (r"\bScik\s+it-learn\b", "Scikit-learn"),
    (r"\bTensor Flow\b", "TensorFlow"), (r"\bTensorflow\b", "TensorFlow"), (r"\bOpen CV\b", "OpenCV"), (r"\bOpenCV\b", "OpenCV"),
    (r"\bMedia Pipe\b", "MediaPipe"), (r"\bMediaPipe\b", "MediaPipe"), (r"\bStream lit\b", "Streamlit"),
    (r"\bStreamlit\b", "Streamlit"), (r"\bFlaskk\b", "Flask"), (r"\bFlask\b", "Flask"), (r"\bTIDB\b", "TiDB"),
    (r"\bMysql\b", "MySQL"), (r"\bSqlite\b", "SQLite"), (r"\bGithub\b", "GitHub"), (r"\bLinkedin\b", "LinkedIn"),
    (r"\bJupyter Notebook\b", "Jupyter Notebook"), (r"\bDevelopmentt\b", "Development"), (r"\bDats Science\b", "Data Science"),
    (r"\bAncuracy\b", "Accuracy"), (r"\bOpportunities\b", "Opportunities"), (r"\bOpportu nities\b", "Opportunities"),
    (r"\bMachine Learning\b", "Machine Learning"), (r"\bDeep Learning\b", "Deep Learning"),
    (r"\bComputer Vision\b", "Computer Vision"), (r"\bData Analysis\b", "Data Analysis"),
]
SCAN_WORDS = [
    (r"\bDats\b", "Data"), (r"\bexperiétete\b", "experience"), (r"\bexperi[ée]nce\b", "experience"),
    (r"\bDevelopmen[t]+t\b", "Development"), (r"\bProgamming\b", "Programming"), (r"\bPeagsamming\b", "Programming"),
    (r"\bOppc\b", "Opportunities"),
]
SCAN_CV_TERMS = [
    "education", "experience", "skills", "projects", "certifications", "summary", "linkedin", "github", "portfolio",
    "work experience", "technical skills", "vfx", "matchmove", "data science", "machine learning", "tensorflow", "python",
]
SUSPICIOUS = "©®™€¤§¶�"
BROKEN = [r"\b[A-Za-z]{1,2}\s+[A-Za-z]{1,2}\b", r"\b[Zz]{2,}[»>]\b", r"\b[eE][@]\b"]
DECORATION = r"^[\s|•●○◦▪▫◆◇★☆✓✔©®™@€£$]+"
EXTENSIONS = ["pdf", "docx", "txt", "jpg", "jpeg", "png"]
