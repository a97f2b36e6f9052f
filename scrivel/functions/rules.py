"""Rule dictionaries. Order matters where a rule says that the first or the longest entry wins."""

# Label aliases by field, in the order that breaks ties.
LABEL_ALIASES = {
    "fullName": ["ho va ten", "họ và tên", "ho ten", "họ tên", "full name", "name", "ho va ten / full name", "họ và tên / full name", "candidate name", "applicant name"],
    "dateOfBirth": ["ngay sinh", "ngày sinh", "date of birth", "dob", "sinh ngay", "sinh ngày", "birthday", "born", "ngay sinh / dob", "ngày sinh / dob", "ngay thang nam sinh", "ngày tháng năm sinh"],
    "cellPhone": ["so dien thoai", "số điện thoại", "dien thoai", "điện thoại", "phone", "mobile", "cell", "tel", "sdt", "sđt", "mobile phone", "phone number", "contact number", "so dt", "số đt"],
    "primaryEmail": ["email", "e-mail", "thu dien tu", "thư điện tử", "dia chi email", "địa chỉ email", "email address"],
    "contactEmail": ["email lien he", "email liên hệ", "contact email"],
    "address": ["dia chi", "địa chỉ", "address", "noi o", "nơi ở", "dia chi thuong tru", "địa chỉ thường trú", "dia chi hien tai", "địa chỉ hiện tại", "dia chi lien he", "địa chỉ liên hệ", "current address", "permanent address"],
    "idCard": ["cmnd", "cccd", "cmnd/cccd", "so cmnd", "số cmnd", "so cccd", "số cccd", "chung minh nhan dan", "chứng minh nhân dân", "can cuoc cong dan", "căn cước công dân", "id card", "id number", "passport", "ho chieu", "hộ chiếu", "personal id", "passport number", "so cmnd / cccd", "cmtnd"],
    "idIssuePlace": ["noi cap", "nơi cấp", "place of issue", "issued at", "noi cap cmnd", "co quan cap", "cơ quan cấp"],
    "idIssueDt": ["ngay cap", "ngày cấp", "issue date", "date of issue", "ngay cap cmnd", "cap ngay", "cấp ngày"],
    "zip": ["ma buu chinh", "mã bưu chính", "postal code", "zip code", "zip"],
    "middleName": ["ten dem", "tên đệm", "middle name"],
    "firstName": ["ho", "họ", "first name", "family name", "surname"],
    "lastName": ["ten", "tên", "last name", "given name"],
}
# Section headers.
SECTION_ALIASES = {
    "education": ["hoc van", "học vấn", "trinh do hoc van", "trình độ học vấn", "education", "educational background", "academic background", "bang cap", "bằng cấp", "qua trinh hoc tap", "quá trình học tập", "dao tao", "đào tạo"],
    "experience": ["kinh nghiem lam viec", "kinh nghiệm làm việc", "kinh nghiem", "kinh nghiệm", "work experience", "professional experience", "employment history", "qua trinh lam viec", "quá trình làm việc", "qua trinh cong tac", "quá trình công tác", "experience", "career history"],
    "languages": ["ngoai ngu", "ngoại ngữ", "ngon ngu", "ngôn ngữ", "languages", "language skills", "foreign languages", "trinh do ngoai ngu", "trình độ ngoại ngữ"],
    "certificates": ["chung chi", "chứng chỉ", "chung nhan", "chứng nhận", "certificates", "certifications", "licenses", "bang cap chung chi", "bằng cấp chứng chỉ"],
    "awards": ["giai thuong", "giải thưởng", "khen thuong", "khen thưởng", "awards", "honors", "awards and achievements", "recognition"],
    "courses": ["khoa hoc", "khóa học", "courses", "training", "dao tao ngan han", "đào tạo ngắn hạn"],
    "family": ["gia dinh", "gia đình", "than nhan", "thân nhân", "family", "family members", "dependents", "nguoi than", "người thân"],
    "skills": ["ky nang", "kỹ năng", "skills", "technical skills", "ky nang tin hoc", "kỹ năng tin học", "computer skills"],
    "projects": ["projects", "du an", "dự án", "academic projects", "personal projects", "notable projects"],
}
# What a person's name does not hold.
NAME_PHRASES = ["các thông tin", "thông tin bắt buộc", "required information", "thông tin cá nhân", "personal information", "personal details", "mục tiêu", "objective", "tóm tắt", "summary", "kinh nghiệm", "experience", "học vấn", "education", "kỹ năng", "skills", "ngôn ngữ", "languages", "chứng chỉ", "certificates", "giải thưởng", "awards", "bằng xuất sắc", "bằng giỏi", "bằng khá", "curriculum vitae", "resume", "profile", "ứng viên", "candidate", "applicant", "quá trình", "công tác", "đào tạo", "page ", "trang ", "about me", "about us", "giới thiệu", "contact", "liên hệ", "lien he", "work experience", "professional", "hoàn thành", "hoan thanh", "application", "transfer", "internal", "đơn xin", "ứng tuyển", "chuyển đổi"]
ORG_WORDS = ["bank", "corporation", "company", "limited", "joint stock", "commercial", "jsc", "llc", "ltd", "inc.", "corp", "ngan hang", "cong ty", "tnhh", "co phan", "thuong mai"]
FAMILY_NAMES = ["nguyen", "nguyễn", "tran", "trần", "le", "lê", "pham", "phạm", "huynh", "huỳnh", "hoang", "hoàng", "phan", "vũ", "vu", "võ", "vo", "dang", "đặng", "bui", "bùi", "do", "đỗ", "ho", "hồ", "ngo", "ngô", "duong", "dương", "ly", "lý", "luong", "lương", "truong", "trương", "ha", "hà", "dao", "đào", "mai", "tang", "tăng", "dinh", "đinh", "lam", "lâm", "trinh", "trịnh", "doan", "đoàn", "cao", "ta", "tạ", "nghiem", "nghiêm", "vuong", "vương", "chau", "châu", "quach", "quách", "tong", "tống", "la", "lã", "phung", "phùng", "thai", "thái"]
# Entries that are no languages, jobs or certificates.
NON_LANGUAGES = ["reading", "writing", "speaking", "listening", "doc", "viet", "noi", "nghe", "native", "basic", "intermediate", "advanced", "fluent", "beginner", "excellent", "good", "fair", "poor", "date", "applicant signature", "signature", "approved", "pending", "signature / date"]
PROGRAMMING = ["python", "java", "javascript", "typescript", "go", "rust", "c", "c++", "c#", "ruby", "php", "swift", "kotlin", "scala", "perl", "r", "matlab", "sql", "html", "css", "bash", "shell", "dart", "lua", "haskell", "objective-c", "groovy", "clojure", "elixir", "vba", "sas", "react", "angular", "vue", "node.js", "express", "django", "flask", "spring", "laravel", "rails", "next.js"]
NON_JOBS = ["job reference", "expected salary", "willing to relocate", "available from", "notice period", "start date", "desired position", "salary expectation", "references"]
CERTIFICATE_HEADERS = ["issuer", "year", "name", "date", "status", "no", "stt", "certificate id", "credential id"]
LANGUAGE_KEYS = ["languages", "language", "ngon ngu", "ngoai ngu", "foreign languages"]
# Patterns of lines that are no data; without multi-line mode ^ and $ hold a whole block.
NOISE = [r"(?iu)^Page\s+\d+\s+of\s+\d+$", r"(?iu)^Trang\s+\d+\s*/\s*\d+$", r"^\d+\s*/\s*\d+$", r"(?iu)^I accept the\b", r"(?iu)^I commit not to\b", r"^TRUE$|^FALSE$", r"^_{4,}\s*$", r"(?iu)^(Approved|Pending)\s+_{3,}"]
FORM_LABELS = [r"(?iu)^(Từ|Tới|From|To)\s*\*\s*$", r"\*\s*$", r"(?iu)^(Name of company|Tên đơn vị công tác|Chức vụ|Position_W|Lý do thôi việc)\s*\*?\s*$", r"(?iu)^(Các thông tin bắt buộc|Required information)\s*\*?\s*$", r"(?iu)^BẠN BIẾT THÔNG TIN TUYỂN DỤNG", r"(?iu)^(DISCIPLINE|KỶ LUẬT)\s*$", r"(?iu)^(Chi tiết về|Details about)", r"(?iu)^(Giải thích cho vị trí|Explain for position)", r"(?iu)^(Approved|Pending)\s*_{2,}", r"(?iu)^(Applicant\s+)?Signature\b", r"(?iu)^Signature\s*/\s*Date", r"^_{4,}\s*$"]
FORM_KEYWORDS = ["các thông tin bắt buộc", "required information", "page 1 of", "page 2 of", "trang 1", "i accept the", "i commit not to", "position_w", "name of company", "tên đơn vị công tác", "lý do thôi việc", "bạn biết thông tin tuyển dụng", "giải thích cho vị trí", "chi tiết về kinh nghiệm"]
SIGNAL_WEIGHTS = {"table_density": 0.25, "asterisk_labels": 0.20, "form_keywords": 0.25, "font_variance": 0.10, "picklist_ids": 0.10, "multi_page_tables": 0.10}
# Regular expressions.
EMAIL = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"
PHONE_VN = r"(?<![a-zA-Z\d])(?:\(?\+?84\)?[\s.\-]*|0)(?:[\s.\-]*\d){9,10}(?!\d)"
PHONE_INTL = r"(?<![a-zA-Z\d])\(?\+\d{1,3}\)?[\s.\-]*(?:\(?\d{1,4}\)?[\s.\-]*)?\d(?:[\s.\-]*\d){5,11}(?!\d)"
BULLET = r"^[-•●○*+>]\s"
NUMBERED = r"^\d{1,2}[.)]\s"
_MONTHS = "(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*"
DATE = rf"(?iu)(?:\d{{1,2}}[/\-\.]\d{{1,2}}[/\-\.]\d{{2,4}}|\d{{2,4}}[/\-\.]\d{{1,2}}[/\-\.]\d{{1,2}}|{_MONTHS}[\s,]+\d{{1,2}}[\s,]+\d{{4}}|\d{{1,2}}[\s,]+{_MONTHS}[\s,]+\d{{4}}|(?:thang|tháng)\s+\d{{1,2}}[/\-,\s]+(?:nam|năm)\s+\d{{4}}|T\d{{1,2}}/\d{{4}}|\d{{1,2}}/\d{{4}})"
ID_NUMBER = r"\b([1-9]\d{8}|[0-9]\d{11})\b"
YEAR_RANGE = r"(?iu)(\d{4})\s*[-–—]\s*(\d{4}|(?:nay|present|current|hien tai|hiện tại))"
MONTH_RANGE = r"(?iu)T(\d{1,2})/(\d{4})\s*[-–—]\s*T(\d{1,2})/(\d{4})"
PICKLIST_ID = r"\b1\d{4}\b"
HONORIFIC = r"(?i)^(Dr|Mr|Ms|Mrs|Prof|TS|ThS|PGS|GS)\.?\s+"
INLINE_LANGUAGE = r"^([A-Za-zÀ-ɏ]+(?:\s[A-Za-zÀ-ɏ]+)?)\s*(?:\(([^)]+)\)|[-–—:]\s*([A-Za-z0-9.]+))?"
PERIOD = r"(.+?)\s*[-–—]\s*(.+)"
PAREN_YEAR = r"\((\d{4})\)"
TEST_SCORE = r"(ielts|toefl|toeic)\s*[:.]?\s*([\d.]+)"
ONGOING = ["present", "current", "now", "nay", "hien tai", "hiện tại", "den nay", "đến nay", "ongoing"]
OPEN_ENDS = ["nay", "present", "current", "hien tai", "hiện tại"]
FAR_FUTURE_MS = 253402214400000
# Ordered keyword to value maps, the first hit counts.
DEGREES = {"bachelor": "Bachelor", "cu nhan": "Bachelor", "master": "Master", "thac si": "Master", "thac sy": "Master", "phd": "PhD", "tien si": "PhD", "tien sy": "PhD", "mba": "MBA", "engineer": "Engineer", "ky su": "Engineer", "college": "College", "cao dang": "College", "high school": "High School", "thpt": "High School", "certificate": "Certificate", "chung chi": "Certificate", "xuat sac": "Excellent"}
GRADES = {"excellent": "Excellent", "xuat sac": "Excellent", "very good": "Very Good", "gioi": "Good", "good": "Good", "kha": "Merit", "distinction": "Distinction"}
PROFICIENCY = {"fluent": "Fluent", "thong thao": "Fluent", "intermediate": "Intermediate", "trung cap": "Intermediate", "beginner": "Beginner", "co ban": "Beginner", "native": "Fluent", "advanced": "Fluent", "basic": "Beginner", "elementary": "Beginner", "good": "Intermediate", "fair": "Intermediate"}
SCHOOL_WORDS = ["university", "dai hoc", "institute", "hoc vien", "college", "truong"]
COMPANY_WORDS = ["company", "corp", "llc", "ltd", "inc", "jsc", "công ty", "cong ty", "tnhh", "co.", "group", "bank", "ngân hàng", "telecom"]
TITLE_WORDS = ["manager", "director", "engineer", "developer", "specialist", "analyst", "assistant", "officer", "supervisor", "lead", "head", "chief", "giám đốc", "trưởng", "chuyên viên", "nhân viên", "phó", "trợ lý", "quản lý", "senior", "intern", "thực tập", "lecturer", "researcher", "teacher", "professor", "scientist", "consultant"]
# Table kinds by header words, in order, and column roles.
ROUTER = [("experience", ["ten don vi cong tac", "name of company", "chuc vu", "position", "company", "employer", "department"]), ("education", ["truong", "school", "university", "bang cap", "degree", "institution", "field of study"]), ("language", ["language", "ngoai ngu", "ngon ngu"]), ("certificate", ["certification", "certificate", "chung chi", "chung nhan"])]
ABBREVIATIONS = {"tp hcm": ["ho chi minh", "hồ chí minh"], "tp. hcm": ["ho chi minh", "hồ chí minh"], "tphcm": ["ho chi minh", "hồ chí minh"], "hn": ["ha noi", "hà nội"], "tp. hn": ["ha noi", "hà nội"], "sg": ["ho chi minh"], "mba": ["master", "master of business administration"], "cu nhan": ["cử nhân", "bachelor"], "thac si": ["thạc sĩ", "master"], "tien si": ["tiến sĩ", "phd"], "ky su": ["kỹ sư", "engineer"], "cccd": ["căn cước công dân", "people identification card"], "cmnd": ["chứng minh nhân dân", "people identification card"], "cmtnd": ["chứng minh nhân dân", "people identification card"]}
# Records.
DEFAULTS = {"anonymized": "0", "shareProfile": "1", "agreeToPrivacyStatement": "true"}
SECTION_OF = {"education": "education", "outsideWorkExperience": "experience", "languages": "languages", "certificates": "certificates", "awards": "awards", "courses": "courses", "familyMember": "family", "Disciplinary": "disciplinary"}
REQUIRED_KEYS = {"education": ["degree", "school"], "outsideWorkExperience": ["startTitle", "employer"], "languages": ["language"], "certificates": ["name"], "awards": ["name"], "courses": ["name"], "familyMember": ["firstName"]}
VALID_DATE, VALID_EMAIL, VALID_PHONE = r"^/Date\(-?\d+\)/$", r"^[^@\s]+@[^@\s]+\.[^@\s]+$", r"[\d\s\-\+\(\)]{7,}"
# Weights by path; others weigh 1.
WEIGHTS = dict.fromkeys(["personal_info.full_name", "personal_info.email", "personal_info.phone", "position_applied.title", "current_employment.employee_id", "current_employment.position", "education", "work_experience"], 3.0) | dict.fromkeys(["personal_info.date_of_birth", "personal_info.gender", "personal_info.nationality", "personal_info.address", "personal_info.city", "personal_info.country", "personal_info.id_number", "position_applied.department", "position_applied.reference_number", "position_applied.expected_salary", "current_employment.department", "current_employment.branch", "current_employment.direct_manager", "summary", "skills", "certifications", "languages", "publications"], 2.0)
# Headings of grids written as lines, and what tells degrees and certificates apart.
EDUCATION_GRID = {"degree": "degree", "degree/cert": "degree", "bang cap": "degree", "institution": "school", "school": "school", "university": "school", "truong": "school", "year": "year", "nam": "year", "gpa/grade": "grade", "gpa": "grade", "xep loai": "grade", "field": "field", "major": "field", "nganh": "field"}
EXPERIENCE_GRID = {"position": "title", "title": "title", "chuc vu": "title", "vi tri": "title", "company": "company", "employer": "company", "ten don vi": "company", "from": "from", "tu": "from", "start": "from", "to": "to", "den": "to", "end": "to", "period": "period", "thoi gian": "period", "location": "location", "dia diem": "location"}
CERTIFICATE_WORDS = ["certified", "certificate", "certification", "cfa", "frm", "pmp", "aws", "cisco", "itil", "professional"]
# A degree among the first three words of a line begins an entry.
DEGREE_STARTS = r"bachelor|master|phd|ph\.d|mba|engineer|b\.s\.?|b\.a\.?|m\.s\.?|m\.a\.?|high school|diploma|cu nhan|thac si|tien si|ky su|cao dang|thpt"
DEGREE_WORDS = r"(?i)\b(B\.?[AS]\.?|M\.?[AS]\.?|Ph\.?D|Bachelor|Master|Doctor|MBA|Engineer)\b"
ACADEMIES = ["university", "academy", "institute", "college", "school", "rmit", "vietnam"]
