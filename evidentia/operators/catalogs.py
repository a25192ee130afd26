"""Term catalogs and ordered rules of posting analysis, as small tables that a caller can replace.

Fixed values: canonical names with their variants, in catalog order.
"""

from __future__ import annotations

TECHNOLOGIES = {
    "Python": ("python",), "JavaScript": ("javascript",), "TypeScript": ("typescript",), "Java": ("java",), "C++": ("c++",), "C#": ("c#",),
    "Go": ("golang", "go language"), "Rust": ("rust",), "SQL": ("sql",), "PostgreSQL": ("postgresql", "postgres"), "MySQL": ("mysql",),
    "MongoDB": ("mongodb", "mongo"), "Redis": ("redis",), "AWS": ("aws", "amazon web services"), "Azure": ("azure",), "GCP": ("gcp", "google cloud"),
    "Docker": ("docker",), "Kubernetes": ("kubernetes", "k8s"), "Terraform": ("terraform",), "Git": ("git",), "Linux": ("linux",),
    "FastAPI": ("fastapi",), "Django": ("django",), "Flask": ("flask",), "React": ("react", "react.js"), "Node.js": ("node.js", "nodejs"),
    "PyTorch": ("pytorch",), "TensorFlow": ("tensorflow",), "scikit-learn": ("scikit-learn", "sklearn"), "LangChain": ("langchain",),
    "LangGraph": ("langgraph",), "OpenAI": ("openai",), "APIs": ("api", "rest api", "restful api"), "Webhooks": ("webhook",),
    "GraphQL": ("graphql",), "Kafka": ("kafka",), "Spark": ("apache spark", "spark"), "Airflow": ("airflow",), "Snowflake": ("snowflake",),
    "Embeddings": ("embedding",), "Selenium": ("selenium",), "Playwright": ("playwright",), "BeautifulSoup": ("beautifulsoup", "beautiful soup"),
    "GitHub": ("github",), "n8n": ("n8n",), "Zapier": ("zapier",), "Make": ("make.com",), "Slack": ("slack",),
    "Amazon Seller Central": ("amazon seller central",),
}
SKILLS = {
    "Artificial Intelligence": ("artificial intelligence",), "Machine Learning": ("machine learning",), "Generative AI": ("generative ai", "genai"),
    "Natural Language Processing": ("natural language processing", "nlp"), "Large Language Models": ("large language model", "llm"),
    "Retrieval-Augmented Generation": ("retrieval-augmented generation", "rag"), "Prompt Engineering": ("prompt engineering",),
    "Vector Databases": ("vector database", "vector store"), "Data Engineering": ("data engineering",),
    "Backend Development": ("backend development", "backend engineer"), "API Design": ("api design",), "Microservices": ("microservice",),
    "Distributed Systems": ("distributed system",), "Cloud Computing": ("cloud computing", "cloud architecture"), "DevOps": ("devops",),
    "CI/CD": ("ci/cd", "continuous integration"), "Test Automation": ("test automation", "automated testing"), "System Design": ("system design",),
    "Data Structures": ("data structure",), "Algorithms": ("algorithm",), "Automation": ("automation", "automated workflow"),
    "Web Scraping": ("web scraping", "scraping"), "AI Agents": ("ai agent", "agent workflow", "agents"), "Workflow Design": ("workflow",),
}
SOFT_SKILLS = {
    "Communication": ("communication", "communicate"), "Collaboration": ("collaboration", "collaborate", "cross-functional"),
    "Leadership": ("leadership", "mentor", "mentoring"), "Problem Solving": ("problem solving", "problem-solving"),
    "Ownership": ("ownership", "self-starter"), "Adaptability": ("adaptability", "adaptable"),
}
DOMAINS = {
    "SaaS": ("saas",), "FinTech": ("fintech", "financial technology"), "HealthTech": ("healthtech", "healthcare"),
    "E-commerce": ("e-commerce", "ecommerce"), "Cybersecurity": ("cybersecurity", "information security"),
    "Developer Tools": ("developer tools", "developer platform"), "Data Platform": ("data platform",), "AI Platform": ("ai platform",),
}
EDUCATION = {
    "Artificial Intelligence": ("artificial intelligence", "ai"), "Computer Science": ("computer science",), "Machine Learning": ("machine learning",),
}
PREFERRED_MARKERS = ("bonus", "desired", "ideally", "nice to have", "nice-to-have", "preferred", "plus")
SECTION_HEADINGS = {
    "responsibilities": "responsibilities", "what you will do": "responsibilities", "what you'll do": "responsibilities",
    "the role": "responsibilities", "requirements": "qualifications", "required qualifications": "qualifications",
    "qualifications": "qualifications", "what we are looking for": "qualifications", "what we're looking for": "qualifications",
    "preferred qualifications": "preferred", "preferred skills": "preferred", "nice to have": "preferred", "nice-to-have": "preferred",
}
RED_FLAGS = {
    "rockstar": "Uses vague 'rockstar' language", "ninja": "Uses vague 'ninja' language", "unpaid": "Mentions unpaid work",
    "wear many hats": "Suggests an unusually broad role scope", "always on": "May imply an always-on availability expectation",
    "24/7": "May imply a 24/7 availability expectation", "equity only": "Mentions equity-only compensation",
    "competitive compensation": "Uses vague compensation wording", "competitive salary": "Uses vague compensation wording",
    "unpaid test": "Mentions an unpaid test task", "unpaid assignment": "Mentions an unpaid test task",
    "too good to be true": "Uses suspicious wording",
}
UNREALISTIC = "Contains unrealistic requirements for the advertised seniority"
SENIORITY_BY_TITLE = (
    ("intern", "intern"), ("junior", "junior"), ("entry", "junior"), ("principal", "principal"), ("staff", "staff"), ("lead", "lead"),
    ("manager", "manager"), ("director", "director"), ("chief", "executive"), ("vp", "executive"), ("senior", "senior"),
)
