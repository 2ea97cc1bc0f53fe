"""Lists, patterns, weights and cut points that results depend on, in their natural order."""

# Words that lower the additive score, in two editions. Texts are lower-cased before the search, the words
# are not, so those with capitals never match; they are kept for compatibility.
HEDGES_LONG = (
    "抱歉", "对不起", "无法", "不能", "不会", "不知道", "不清楚", "不懂", "可能", "也许", "大概", "或许", "恐怕", "难说", "不好说",
    "作为 AI", "作为语言模型", "作为助手", "作为一个人工智能", "作为一个 AI",
    "好的", "好滴", "好的呢", "好哒", "好呀", "当然", "当然可以", "没问题", "没问题哒", "没问题的",
    "让我", "让我来", "我来", "我来帮你", "我来帮助你", "我来为你",
    "请问", "有什么", "有什么可以帮你", "有什么能帮到你", "有什么可以帮你的", "希望", "相信", "觉得", "认为",
    "sorry", "apologies", "cannot", "can't", "unable", "don't know", "dont know", "maybe", "perhaps", "probably", "likely", "afraid",
    "as an AI", "as an assistant", "as a language model", "as an AI assistant",
    "Sure", "Sure thing", "Of course", "No problem", "No worries", "No prob", "Let me", "I will", "I can", "I'll", "I am", "I'm",
    "How can I help", "What can I do", "Is there anything", "feel free", "hope", "believe", "think", "feel",
)
HEDGES_SHORT = (
    "抱歉", "无法", "不知道", "不清楚", "可能", "也许", "sorry", "cannot", "unable", "don't know", "maybe",
    "作为 AI", "作为语言模型", "as an AI", "as a language model",
)

# Openings that mark a template, matched at the start of the stripped text without regard to case. The blanks
# around the bars of the first ones are part of the patterns.
OPENINGS_LONG = (
    r"^(好的 | 好滴 | 好的呢 | 好哒 | 好呀 | 当然 | 当然可以 | 没问题 | 没问题哒 | 没问题的).*",
    r"^(让我 | 让我来 | 我来 | 我来帮你 | 我来帮助你 | 我来为你).*",
    r"^(有什么 | 请问 | 有什么可以帮你 | 有什么能帮到你 | 有什么可以帮你的).*",
    r"^(作为 (AI|AI 助手 | 语言模型 | 助手 | 一个人工智能 | 一个 AI)).*",
    r"^(希望 | 相信 | 觉得 | 认为 | 抱歉 | 对不起).*",
    r"^(你好 | 您好 | 嗨 | 嗨喽 | hello|hi).*$",
    r"^[嗯啊哦嘛]{1,3}$",
    r"^(Sure|Sure thing|Of course|No problem|No worries|No prob).*",
    r"^(Let me|I will|I can|I'll|I am|I'm).*",
    r"^(As an (AI|AI assistant|language model|helper)).*",
    r"^(How can I help|What can I do|Is there anything|feel free).*",
    r"^(Hello|Hi|Hey|Greetings).*$",
    r"^(I hope|I believe|I think|I feel).*",
)
OPENINGS_SHORT = (r"^好的，.*", r"^当然，.*", r"^让我.*", r"^我来.*", r"^有什么.*", r"^请问.*", r"^Sure,.*", r"^Of course,.*", r"^Let me.*", r"^I can.*")

# Parts of a text that decide the type score.
TYPE_LONG = ((1.0, ("def ", "class ", "import ", "function ", "code", "```")), (0.9, ("api", "http", "json", "database", "server", "config")), (0.85, ("教程", "指南", "文档", "tutorial", "guide", "步骤")))
TYPE_SHORT = ((1.0, ("def ", "class ", "import ", "function ", "code")), (0.9, ("api", "http", "json", "database", "server")), (0.85, ("教程", "指南", "文档", "tutorial", "guide")))
TYPE_ELSE = 0.7

# Score by category.
CATEGORY_LONG = {"user/preferences": 1.5, "agent/skills": 1.3, "agent/memories": 1.2, "resources/projects": 1.3, "resources/tech": 1.3, "resources/code": 1.4, "resources/docs": 1.3, "resources/api": 1.3, "general": 1.0}
CATEGORY_SHORT = {"user/preferences": 1.5, "agent/skills": 1.3, "agent/memories": 1.2, "resources/projects": 1.3, "general": 1.0}

# Weights of type, length, entity, destructive, template, metadata.
WEIGHTS_LONG = (0.10, 0.20, 0.10, 0.30, 0.25, 0.05)
WEIGHTS_SHORT = (0.20, 0.15, 0.20, 0.20, 0.15, 0.10)

# Greetings and characters of texts that say nothing.
GREETINGS = ("你好", "您好", "早", "早上好", "下午好", "晚上好", "晚安", "嗨", "hello", "hi", "hey", "greetings")
GREETINGS_STUB = ("你好", "hi", "hello")
FILLERS, DOTS = "嗯啊哦嘛呃呀", ".．"

# The multiplicative score.
TYPE_FACTOR = {"code": 1.2, "knowledge": 1.2, "event": 0.9, "conversation": 0.9, "noise": 0.3}
ENTITY_WORDS = ("API", "AI", "ML", "DB", "System", "系统", "项目", "平台")
TEMPLATE_PARTS = ("有人提到", "但不是用于", "类似的", "方案")
TEMPLATE_PARTS_LEARNER = ("有人提到", "但不是用于", "类似的")
STOP_CHARS_LEARNER = "的了吗是和在了有"

# The noise test.
STOP_CHARS = "的了吗是和在了有就这以个不我们要可以后上为也你他都吧嘛呢没还又着那从好没自己吗到最她他让用能做对没小可大没太"
STOP_WORDS = (
    "the", "a", "an", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "could", "should", "may", "might", "must", "shall", "can", "need", "dare",
    "ought", "used", "to", "of", "in", "for", "on", "with", "at", "by", "from", "as", "into", "through", "during", "before", "after", "above", "below", "between", "under", "again", "further", "then",
    "once", "here", "there", "when", "where", "why", "how", "all", "each", "few", "more", "most", "other", "some", "such", "no", "nor", "not", "only", "own", "same", "so", "than", "too", "very", "just",
    "and", "but", "if", "or", "because", "until", "while", "although", "though", "whenever", "wherever", "whether", "which", "who", "whoever", "whom", "whose", "what", "whatever",
    "that", "this", "these", "those", "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "your", "yours", "yourself", "yourselves", "he", "him", "his", "himself", "she", "her",
    "hers", "herself", "it", "its", "itself", "they", "them", "their", "theirs", "themselves", "am", "having", "doing", "about", "against", "up", "down", "out", "off", "over", "any", "both", "s",
    "t", "don", "now",
)
PLACEHOLDERS = ("{", "}", "XXX", "___", "***", "...")

# Parts of a query that lead to a directory, in the order of the directories.
ROUTES = (("/user/preferences", ("偏好", "preference", "习惯")), ("/agent/skills", ("技能", "skill", "能力", "部署")), ("/resources/projects", ("项目", "project")), ("/agent/memories", ("记忆", "memory", "历史")))
ROUTE_ELSE = "/agent/memories"
STANDARD_DIRECTORIES = ("/user/preferences", "/user/habits", "/user/profile", "/agent/skills", "/agent/memories", "/agent/instructions", "/resources/projects", "/resources/docs", "/resources/code")
