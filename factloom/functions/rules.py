"""Rules that read durable facts out of messages, as data: patterns, labels, keys and the texts that are no statements.

All are fixed values: they decide which facts a message gives, and stand as they must match. Patterns are read by Java's
regular expressions over normalised text (one line, single blanks).
"""

from __future__ import annotations

from dataclasses import dataclass

# Texts that are never kept, and texts that are kept for their owner alone.
UNSAFE = (
    r"(?i)ignore\s+(all\s+)?(previous\s+)?instructions?",
    r"(?i)system\s*prompt",
    r"(?i)developer\s+message",
    "忽略.{0,12}(规则|指令|提示词|系统)",
    "(执行|运行).{0,12}(命令|脚本)",
    r"(?i)\bsk-[a-z0-9_-]{12,}\b",
    r"(?i)\b(?:api[_ -]?key|password|passwd|access[_ -]?token)\b",
    "(?:密码|验证码|访问令牌|密钥)",
)
PRIVATE = (
    r"(?i)(?:身份证|身份证号|id\s*card)",
    "(?i)(?:家庭住址|详细地址|家庭地址|住址|address)",
    r"(?i)(?:手机号|手机号码|电话号码|联系电话|phone\s*number)",
    r"(?i)(?:银行卡|银行账号|信用卡|bank\s*account|credit\s*card)",
    "(?i)(?:生日|出生日期|病历|诊断|疾病|过敏|用药|medication|diagnosed|medical)",
    "(?:用户|我)(?:现在|目前|现)?住在",
    r"(?i)(?:用户所在地|user\s+location|健康信息|health\s+condition)",
    r"(?i)(?:车牌|license\s*plate)",
    "(?i)(?:妻子|丈夫|伴侣|爱人|spouse|wife|husband|partner)",
    r"(?i)\b[\w.+-]+@[\w.-]+\.[a-z]{2,}\b",
    r"(?:\+?86[-\s]?)?1[3-9]\d{9}\b",
    r"\b\d{17}[\dXx]\b",
)

# Messages and clauses that state nothing of their own.
NO_FACTS = (
    "^(?:如果|假如|假设|假定|要是)",
    "(?:小说|电影|故事|角色|他说|她说|别人说|你(?:刚才)?说).{0,100}(?:我叫|我的(?:名字|姓名)|我喜欢|我住在)",
    "(?:不是真的|并非事实|那是错的|说错了)",
    "(?:以前|过去|曾经).{0,120}(?:现在|如今|目前)",
    r"(?:十年前|[一二三四五六七八九十百〇零两\d]+年前|以前|过去|曾经).{0,120}(?:后来|之后).{0,80}(?:转行|不再|已经不是|已经停止)",
)
NEGATED_NAME = "(?:我不叫|我的(?:名字|姓名)不是|我并不叫)"
META = (
    r"^(?:请)?(?:翻译|把.{0,100}翻译|举(?:个)?例(?:子)?|举例|例如|比如|示例)(?:这句|如下|是)?[：:，,\s]",
    "^(?:角色扮演|扮演角色|假想场景|虚构设定|在(?:小说|故事|电影|游戏)中)",
)
REPORTED = r"(?:^|[，。！？,.!?])(?!(?:我|医生)说)(?:他|她|他们|她们|别人|朋友|同事|[\p{L}\p{N}]{2,16})说[“\"'‘’]?(?:我|我的)"
PASSING = (
    r"(?:我喜欢|我偏好)\s*(?:今天的天气|(?:你)?刚才的(?:回答|回复|结果|表现)|这次的(?:回答|回复|结果|体验))",
    r"(?:刚才|临时|暂时|这(?:两|几|\d+)(?:秒|分钟|小时)).{0,40}(?:我)?(?:在|正在)(?:做|进行|测试)",
)
ASKING = "^(?:请问|能否|可否|为什么|怎么|怎样)"
QUESTION = r"(?:吗|么|呢)\s*[？?]?$|[？?]\s*$"
SENTENCE_ENDS = "[。！？!?;；\\n]+"
CLAUSE_COMMA = r"(?iu)[，,](?=\s*(?:我|我的|你|您|请问|请|记住|别忘了|每周|平时|通常|现在|也|而且|同时|I\b|My\b|Call\b|Remember\b))"

# Corrections over several clauses, and the answers and questions of a confirmation.
NAME_CORRECTION = r"(?:我的(?:名字|姓名))(?:不是)\s*[^，。！？,.!?]{1,40}[，,]\s*(?:而是|是)\s*([^，。！？,.!?]{1,40})"
MOVED = r"我(?:以前|过去|曾经)住(?:在)?\s*([^，。！？,.!?]{1,80})[，,]\s*(?:我)?(?:现在|目前|如今)住(?:在)?\s*([^，。！？,.!?]{1,80})"
SETTLED = r"(?:我)?搬(?:来|到)\s*([\p{L}]{1,30})(?=(?:已经|有|[，,])).{0,60}(?:现在|目前|如今)(?:仍|还)(?:住|生活)(?:在)?(?:这里|当地|这儿)?"
IN_WORK = r"职业方面[，,]?(?:我)?(?:是|做|从事)\s*([^，。！？,.!?\n]{1,80})"
YES = r"(?iu)^(?:是的|对(?:的)?|没错|确实|可以这么说|yes|correct|that's right)[。！!.\s]*$"
ASKED_PREFERENCE = (
    r"(?:所以|也就是说|确认一下)?(?:你|您)(?:是)?(?:喜欢|偏好)\s*([^，。！？,.!?吗]{1,100})(?:吗|对吗|是不是)?[？?]?$",
    "(?iu)(?:do you|you) (?:like|prefer)\\s+([^,.!?]{1,100})[?]?$",
)
REMEMBER = (r"(?:请记住|记住)[：:，,\s]*(?:这件事[：:，,\s]*)?([^。！？.!?\n]{2,300})", r"(?i)\bremember(?: that)?\s+([^.!?\n]{2,300})")


@dataclass(frozen=True)
class Rule:
    """pattern gives the value as its last group; a first group of two stands before it. before, after: fixed texts around.
    needs: texts, in lower case, of which every match holds one, so that a clause without them is spared the pattern."""

    kind: str
    label: str
    pattern: str
    key: str | None = None
    single: bool = False
    groups: int = 1
    before: str = ""
    after: str = ""
    needs: tuple[str, ...] = ()


# The rules, in the order in which their facts are listed.
RULES = (
    Rule("identity", "用户姓名/名字", r"(?:我叫|我的(?:名字|姓名)是)\s*([^，。！？,.!?\n]{1,40})", "profile.name", True, needs=("我叫", "我的姓名是", "我的名字是")),
    Rule("identity", "用户希望的称呼", r"(?:请)?(?:叫我|称呼我(?:为)?)\s*([^，。！？,.!?\n]{1,40})", "profile.preferred_name", True, needs=("叫我", "称呼我")),
    Rule("identity", "用户生日", r"(?:我的生日是|我生日是)\s*([^。！？.!?\n]{1,80})", "profile.birthday", True, needs=("生日是",)),
    Rule("identity", "用户希望的称呼", r"(?:大家|朋友们?|同事们?|别人)(?:一般|平时|通常)?(?:都)?(?:叫|喊|称呼)我\s*([^，。！？,.!?\n]{1,40})", "profile.preferred_name", True, needs=("叫我", "喊我", "称呼我")),
    Rule("identity", "用户希望的称呼", r"(?:大伙|伙伴们?)(?:一般|平时|平常|通常)?(?:都)?(?:叫|喊|称呼)我\s*([^，。！？,.!?\n]{1,40})", "profile.preferred_name", True, needs=("大伙", "伙伴")),
    Rule("identity", "用户希望的称呼", r"([^，。！？,.!?\n]{1,40})是我(?:常用|平时用|习惯用)的?(?:昵称|称呼)", "profile.preferred_name", True, needs=("是我",)),
    Rule("preference", "用户喜好/偏好", r"我(?:最)?(?:喜欢|偏好)\s*([^。！？.!?\n]{1,200})", needs=("喜欢", "偏好")),
    Rule("preference", "用户喜好/偏好", r"也(?:喜欢|偏好)\s*([^。！？.!?\n]{1,200})", needs=("也偏好", "也喜欢")),
    Rule("preference", "用户不喜欢", r"我(?:不喜欢|讨厌)\s*([^。！？.!?\n]{1,200})", needs=("我讨厌", "我不喜欢")),
    Rule("project", "用户当前项目", r"我(?:正在|在)(?:做|开发|研究|进行)\s*([^。！？.!?\n]{1,200})", "project.current", True, needs=("我在", "我正在")),
    Rule("preference", "用户喜好/偏好", "([^，。！？,.!?\\n]{1,80})是我的最爱", needs=("是我的最爱",)),
    Rule("preference", "用户喜好/偏好", r"比起[^，。！？,.!?\n]{1,80}我(?:更爱|更喜欢|更偏好)\s*([^，。！？,.!?\n]{1,100})", needs=("比起",)),
    Rule("health", "用户过敏信息", r"我对\s*([^，。！？,.!?\n]{1,80})\s*过敏", "health.allergy", needs=("我对",)),
    Rule("health", "用户健康信息", r"医生说我(?:有|患有)\s*([^，。！？,.!?\n]{1,100})", "health.condition", needs=("医生说我",)),
    Rule("relationship", "用户宠物名字", r"我家(?:的)?(?:猫咪|猫|狗狗|狗|宠物)(?:的)?(?:名字)?(?:叫|是)\s*([^，。！？,.!?\n]{1,60})", "relationship.pet_name", needs=("我家",)),
    Rule("relationship", "用户宠物名字", r"我的(?:猫咪|猫|狗狗|狗|宠物)(?:的)?(?:名字)?(?:叫|是)\s*([^，。！？,.!?\n]{1,60})", "relationship.pet_name", needs=("我的",)),
    Rule("identity", "用户所在地", r"我(?:现在|目前|现)?住在\s*([^，。！？,.!?\n]{1,100})", "profile.location", True, needs=("住在",)),
    Rule("identity", "用户所在地", r"(?:我的)?(?:常住地|居住地|所在地)(?:是|在)\s*([^，。！？,.!?\n]{1,100})", "profile.location", True, needs=("常住地", "居住地", "所在地")),
    Rule("identity", "用户所在地", r"(?:我)?搬(?:来|到)\s*([\p{L}]{1,30})(?=(?:已经|有|[，,])).{0,40}(?:现在|目前|如今)(?:仍|还)(?:住|生活)", "profile.location", True, needs=("搬到", "搬来")),
    Rule("routine", "用户固定安排", r"(?<![\p{L}\p{N}])(?:我)?每周([一二三四五六日天1-7])(?:我)?(?:都会|会|通常)?(?:去)?\s*([^，。！？,.!?\n]{1,80})", "routine.weekly", groups=2, before="每周", needs=("每周",)),
    Rule("routine", "用户固定安排", r"(?:我)?(周末|周[六日天])(?:早上|上午|下午|晚上)?(?:我)?(?:都会|会|通常)?固定(?:去)?\s*([^，。！？,.!?\n]{1,80})", "routine.weekend", groups=2, needs=("固定",)),
    Rule("routine", "用户缴房租日期", r"(?:我)?每个?月\s*([一二三四五六七八九十百〇零两\d]{1,4})\s*(?:日|号)(?:我)?(?:交|付|缴)(?:纳)?房租", "routine.rent_day", True, before="每月", after="号", needs=("房租",)),
    Rule("identity", "用户职业", r"我的职业是\s*([^，。！？,.!?\n]{1,80})", "profile.occupation", True, needs=("我的职业是",)),
    Rule("identity", "用户职业", IN_WORK, "profile.occupation", True, needs=("职业方面",)),
    Rule("identity", "用户职业", r"^(?:白天|晚上|目前|现在)?(?:我)?在[^，。！？,.!?\n]{1,30}(?:当|做)\s*([^，。！？,.!?\n]{1,80})", "profile.occupation", True, needs=("在",)),
    Rule("routine", "用户工作时间偏好", r"我通常\s*([^，。！？,.!?\n]{1,40})(?:工作|办公)", needs=("我通常",)),
    Rule("identity", "用户车牌", r"我的车牌(?:号)?是\s*([\p{L}\p{N}-]{4,20})", "profile.vehicle_plate", needs=("我的车牌",)),
    Rule("relationship", "用户伴侣姓名", r"我的(?:妻子|丈夫|伴侣|爱人)叫\s*([^，。！？,.!?\n]{1,60})", "relationship.partner_name", True, needs=("我的",)),
    Rule("goal", "用户目标", r"我(?:今年)?的目标是\s*([^，。！？,.!?\n]{1,160})", "goal.current", needs=("的目标是",)),
    Rule("goal", "用户目标", r"(?:今年|明年|未来(?:一年)?)(?:的)?(?:打算|计划|目标)(?:是|为)?\s*([^，。！？,.!?\n]{1,160})", "goal.current", True, needs=("今年", "明年", "未来")),
    Rule("identity", "用户电脑设备", r"我的电脑是\s*([^，。！？,.!?\n]{1,100})", "profile.computer", needs=("我的电脑是",)),
    Rule("contact", "用户联系电话", r"我的(?:手机号|手机号码|电话号码|联系电话)是\s*([^，。！？,.!?\n]{5,40})", "profile.phone", True, needs=("我的",)),
    Rule("contact", "用户邮箱", r"(?iu)我的邮箱(?:地址)?是\s*([^，。！？,!?\n\s]+@[\w.-]+\.[a-z]{2,})", "profile.email", True, needs=("我的邮箱",)),
    Rule("preference", "用户常喝饮品", r"(?:饮料|饮品)(?:里|方面)?(?:我)?(?:通常|一般|平常)?(?:会)?(?:选|选择|喝)\s*([^，。！？,.!?\n]{1,100})", needs=("饮品", "饮料")),
    Rule("preference", "用户常喝饮品", r"(?:我)?(?:通常|一般|平常|经常)(?:会)?(?:喝|选择|选)\s*([^，。！？,.!?\n]{1,100})", needs=("平常", "经常", "一般", "通常")),
    Rule("preference", "用户不喜欢", r"(?:吃饭|点菜).{0,20}除了\s*([^，。！？,.!?\n]{1,50})\s*以外(?:我)?都可以", needs=("都可以",)),
    Rule("project", "用户当前项目", r"(?:最近|目前|现在)(?:我)?(?:在|正|正在)?(?:筹备|准备|推进)\s*([^，。！？,.!?\n]{1,200})", "project.current", True, needs=("目前", "现在", "最近")),
    Rule("relationship", "用户宠物名字", r"家里有(?:一)?只[^，。！？,.!?\n]{1,30}[，,]\s*(?:名字)?叫\s*([^，。！？,.!?\n]{1,60})", "relationship.pet_name", needs=("家里有",)),
    Rule("relationship", "用户伴侣姓名", r"我(?:对象|另一半)叫\s*([^，。！？,.!?\n]{1,60})", "relationship.partner_name", True, needs=("我对象叫", "我另一半叫")),
    Rule("health", "用户过敏信息", "^([^，。！？,.!?\\n]{1,50})(?:会|容易)(?:让|使)我.{0,50}(?:过敏|起疹子|呼吸困难|肿胀)", "health.allergy", needs=("让我", "使我")),
    Rule("preference", "用户回答偏好", r"(?:回答|回复)(?:请|要|应该|尽量)?(?:控制在|保持在)\s*([^，。！？,.!?\n]{1,80}?)(?:以内|之内)", "preference.response_style", True, needs=("保持在", "控制在")),
    Rule("preference", "用户回答偏好", r"(?:回答|回复)(?:时)?(?:请|要|应该)?先\s*([^，。！？,.!?\n]{1,80})", "preference.response_style", True, needs=("回答", "回复")),
    Rule("identity", "用户惯用手", r"我是\s*(左撇子|右撇子)", "profile.handedness", True, needs=("我是",)),
    Rule("preference", "用户喜欢的颜色", r"(?:买衣服|选衣服|挑衣服)(?:时)?(?:我)?(?:会)?优先(?:选择|选)\s*([^，。！？,.!?\n]{1,60})", "preference.color", True, needs=("优先选",)),
    Rule("identity", "用户就读院校", r"(?:本科|硕士|博士)(?:阶段)?(?:就读|毕业)于\s*([^，。！？,.!?\n]{1,100})", "profile.education", True, needs=("毕业于", "就读于")),
    Rule("identity", "用户常用编程语言", r"(?:日常|平时)(?:写代码|编程)(?:时)?(?:主要)?(?:会)?用\s*([\p{L}\p{N}+#.-]{1,40})", "profile.programming_language", True, needs=("平时", "日常")),
    Rule("identity", "用户常用编程语言", r"(?iu)(?:我)?(?:日常|平时)(?:主要)?用\s*(Rust|Python|TypeScript|JavaScript|Java|C\+\+|C#|Go)(?=[，。！？,.!?\s]|$)", "profile.programming_language", True, needs=("平时", "日常")),
    Rule("identity", "User name", r"(?i)\bmy name is\s+([^,.!?\n]{1,60})", "profile.name", True, needs=("my name is",)),
    Rule("identity", "Preferred form of address", r"(?i)\bcall me\s+([^,.!?\n]{1,60})", "profile.preferred_name", True, needs=("call me",)),
    Rule("preference", "User preference", r"(?i)\bi (?:prefer|like)\s+([^.!?\n]{1,200})", needs=("i prefer", "i like")),
    Rule("preference", "User dislikes", r"(?i)\bi (?:dislike|hate)\s+([^.!?\n]{1,200})", needs=("i dislike", "i hate")),
    Rule("identity", "User location", r"(?i)\bi (?:am based|live) in\s+([^,.!?\n]{1,100})", "profile.location", True, needs=("i am based in", "i live in")),
    Rule("identity", "User occupation", r"(?i)\bi work as\s+(?:an?\s+)?([^,.!?\n]{1,80})", "profile.occupation", True, needs=("i work as",)),
    Rule("relationship", "User pet name", r"(?i)\bmy (?:dog|cat|pet)(?:'s name)? is\s+([^,.!?\n]{1,60})", "relationship.pet_name", needs=("my dog", "my cat", "my pet")),
    Rule("routine", "User weekend routine", r"(?i)\bon weekends? i (?:usually|normally|often) (?:go )?([^.!?\n]{1,100})", "routine.weekend", needs=("on weekend",)),
    Rule("health", "User allergy", r"(?i)([^.!?\n]{1,80}) (?:give|gives) me (?:an? )?(?:serious )?allergic reaction", "health.allergy", needs=(" allergic reaction",)),
    Rule("preference", "User usual drink", r"(?i)([^.!?\n]{1,80}) is my usual drink", needs=(" is my usual drink",)),
    Rule("identity", "User location", r"(?i)([^.!?\n]{1,80}) has been home for (?:the )?(?:last|past) [^.!?\n]{1,60}", "profile.location", True, needs=(" has been home for ",)),
)

#: One scan that every clause with a fact passes: a text that each rule, or REMEMBER, can't do without.
PRESCAN = (
    "(?i)我|喜欢|偏好|每周|周末|周[六日天]|每个?月|职业|常住地|居住地|所在地|搬[来到]|在.*[当做]|今年|明年|未来|饮[料品]|通常|一般|平常|经常|吃饭|点菜|最近|目前|现在|家里有|回答|回复|[买选挑]衣服|本科|硕士|博士|日常|平时|记住"
    "|my (?:name|dog|cat|pet)|call me|i (?:prefer|like|dislike|hate|am based|live|work)|weekend|allergic reaction|my usual drink|been home for|remember"
)

# Other names of predicates, predicates with one value or a set of values, and other names of values.
PREDICATES = {
    "name": "profile.name", "user.name": "profile.name", "nickname": "profile.preferred_name", "location": "profile.location", "city": "profile.location",
    "occupation": "profile.occupation", "job": "profile.occupation", "birthday": "profile.birthday", "allergy": "health.allergy", "project": "project.current", "pet": "relationship.pet_name",
}
SINGLE = (
    "profile.name", "profile.preferred_name", "profile.location", "profile.occupation", "profile.birthday", "profile.handedness", "profile.email", "profile.phone",
    "relationship.partner_name", "project.current", "preference.response_style",
)
SETS = ("health.allergy", "health.condition", "preference.like", "preference.dislike")
LANGUAGES = {"ts": "TypeScript", "js": "JavaScript", "py": "Python", "golang": "Go", "c sharp": "C#"}
NEGATIVE, POSITIVE = r"(?iu)(?:不喜欢|讨厌|不能吃|避免|过敏|\bdislike\b|\bhate\b)", r"(?iu)(?:喜欢|偏爱|偏好|最爱|\bprefer\b|\blike\b)"
HYPOTHETICAL, SAID, PLANNED = r"(?iu)^(?:如果|假如|假设|要是)|\b(?:if|suppose|assuming)\b", r"(?iu)(?:他说|她说|朋友说|同事说)|\b(?:he|she|they) said\b", r"(?iu)(?:计划|打算|目标|准备)|\b(?:plan|intend|goal)\b"
CONDITION = r"(?:当|每当)([^，。！？,.!?]{1,80})(?:时|的时候)|([^，。！？,.!?]{1,80}时)(?:我)?"
FACT_WORDS = r"(?:不喜欢|讨厌|喜欢|偏爱|偏好|姓名|名字|所在地|职业)\s*(.+)$"
DISLIKED, LIKED = r"(?iu)(?:不喜欢|讨厌|\bdislike\b|\bhate\b)", r"(?iu)(?:喜欢|偏爱|偏好|\bprefer\b|\blike\b)"
LEADS = (
    r"(?iu)^(?:用户|user)(?:的)?(?:姓名(?:是|为)?|名字(?:是|为)?|叫|希望的称呼(?:是|为)?|喜欢|喜好|偏好|爱喝|常喝|不喜欢|讨厌|所在地(?:是|为)?|居住在|住在|职业(?:是|为)?|是)\s*",
    r"(?iu)^(?:the user|user)\s+(?:likes?|prefers?|dislikes?|hates?|lives? in|is based in|works? as)\s+",
)

# How long kinds of facts last, and the texts and predicates that a write policy looks for.
DURABILITY = {"explicit": 1.0, "identity": 0.95, "relationship": 0.92, "health": 0.92, "routine": 0.9, "preference": 0.82, "goal": 0.78, "project": 0.72, "contact": 0.85, "image": 0.65, "other": 0.55}
CORRECTIONS = (
    "(?:不是|不再是|并非).{0,80}(?:而是|现在是|改成|更正为)",
    "(?:更正|纠正|改一下|更新一下).{0,80}(?:是|为|成)",
    "(?:以前|过去|曾经).{0,120}(?:现在|目前|如今)",
    r"(?i)\b(?:not|no longer).{0,80}\b(?:but|now|instead)\b",
    r"(?i)\b(?:correct|update|change)\b.{0,80}\b(?:to|is)\b",
)
NOT_ASSERTED = {
    "question": r"[？?]\s*$",
    "hypothetical": r"(?i)^(?:如果|假如|假设|假定|要是)|\b(?:if|suppose|assuming)\b",
    "reported-speech": "(?:^|[，。！？,.!?])(?:他|她|他们|她们|别人|朋友|同事)说[“\"'‘’]?(?:我|我的)",
    "example-or-fiction": r"(?i)^(?:例如|比如|举例|示例|假想场景|虚构设定|角色扮演)|\b(?:for example|fictional|roleplay)\b",
}
TRANSIENT = (
    r"(?:刚才|临时|暂时|这(?:两|几|\d+)(?:秒|分钟|小时))",
    "(?:今天的天气|刚才的(?:回答|回复)|这次的(?:回答|回复|结果))",
    r"(?i)\b(?:just now|temporarily|for the next few (?:minutes|hours))\b",
)
VAGUE = "(?iu)^(?:这个|那个|它|这里|那里|这样|那样|某个|东西|事情|this|that|it|something)$"
