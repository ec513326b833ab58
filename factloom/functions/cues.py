"""What questions ask for: concepts, cues of intent and routes, and the budgets of each intent.

Fixed values: they decide which facts a question may find. Patterns are in a dialect that both engines read, over lower-case
text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fields that facts and questions are about.
CONCEPTS = {
    "preference.any": "偏好|喜欢|偏爱|爱听|爱看|不喜欢|讨厌|常喝|常吃|prefer|preference|like|dislike|favorite|favourite",
    "profile.name": r"姓名|名字|称呼|叫(?:我|你)|\bname\b|\bcall\b",
    "profile.location": r"所在地|住在|居住|常住|定居|落脚|哪座城市|哪里住|何处生活|(?:哪|什么|哪个).{0,4}城市.{0,6}(?:生活|居住|住过|待过)|based\s+in|live\s+in|has\s+been\s+home",
    "profile.native-language": r"母语|方言|家乡话|从小讲|native\s+language|dialect",
    "profile.shoe-size": r"鞋码|几码.{0,4}鞋|鞋.{0,6}(?:尺码|号码|大小)|shoe\s+size",
    "relationship.pet": r"宠物|毛孩子|猫咪|猫|狗狗|狗|兔子|兔|\bdog\b|\bcat\b|\bpet\b|\brabbit\b",
    "relationship.sibling": "哥哥|姐姐|弟弟|妹妹|兄弟姐妹|手足|sibling|brother|sister",
    "preference.music": r"音乐|歌曲|爵士|爱听|耳机|\bmusic\b|\bsong\b|\bjazz\b",
    "health.allergy": r"过敏|必须避开|食材.{0,10}避开|药.{0,10}(?:不能用|禁用|避开)|(?:不能用|禁用).{0,10}药|allerg|(?:food|medicine|drug).{0,20}(?:avoid|cannot\s+use)|must\s+avoid",
    "project.current": r"当前项目|项目|开发|手头.{0,12}(?:忙|软件|准备|筹备|做)|正在.{0,12}(?:做|准备|开发).{0,8}(?:产品|软件)?|做的产品|哪个软件|\bproject\b|develop|working\s+on",
    "routine.exercise": r"固定安排|每周|锻炼|运动|徒步|游泳|瑜伽|\broutine\b|\bweekly\b|\bexercise\b",
    "profile.operating-system": r"电脑系统|操作系统|运行.{0,8}平台|windows|macos|linux|operating\s+system",
    "preference.response-style": r"回答偏好|回复|回答|篇幅|简洁|详细|\bresponse\b|\breply\b|\bconcise\b",
    "profile.programming-language": r"编程语言|哪门语言|写程序|写代码|技术栈|python|typescript|javascript|rust|c\+\+|programming\s+language|tech\s+stack",
    "preference.drink": r"饮品|喝什么|泡什么|乌龙茶|咖啡|饮料|\bdrink\b|\bbeverage\b|\btea\b|\bcoffee\b",
    "routine.work-time": r"工作习惯|工作时间|(?:什么时候|何时).{0,6}工作|平时.{0,8}工作|夜间|晚上工作|时段.{0,8}效率|效率最高|白天.{0,8}夜|办公|work.{0,12}(?:night|day)",
    "profile.birthday": r"生日|出生日期|生日祝福|庆生|\bbirthday\b|celebrate.{0,8}birthday",
    "relationship.friend": r"好友|朋友|那位朋友|\bfriend\b",
    "preference.food": r"不喜欢.{0,12}(?:食物|吃)|不要(?:放|加)|吃饭|点菜|口味.{0,8}(?:禁忌|避讳)|忌口|不能吃|香菜|\bdislike\b|\bhate\b|cilantro|food.{0,12}(?:preference|restriction)",
    "preference.interface-theme": r"界面.{0,8}(?:主题|模式)|深色主题|黑色主题|dark\s+mode|interface\s+theme",
    "plan.travel": r"旅行|目的地|去哪里玩|下一趟|京都|\btravel\b|\btrip\b|\bdestination\b",
    "preference.book": r"喜欢的书|喜欢.{0,4}(?:哪|什么|哪一)(?:本|部)书|哪(?:一)?本书|什么书|小说|哪部.{0,8}心头好|三体|\bbook\b|\bnovel\b",
    "profile.education": r"毕业院校|高校毕业|大学|本科|硕士|博士|就读|在哪.{0,8}读|\buniversity\b|\bcollege\b|education",
    "preference.color": r"颜色|什么色|色系|衣服.{0,8}色|藏青|墨绿|\bcolor\b|\bcolour\b",
    "routine.rent": r"房租|房东.{0,12}收钱|每月.{0,6}号|\brent\b",
    "profile.occupation": r"职业|做什么工作|靠什么.{0,8}(?:工作|谋生)|谋生|任职|教师|occupation|work\s+as|make.{0,8}living|\bjob\b",
    "relationship.partner": "妻子|丈夫|伴侣|爱人|对象|另一半|spouse|wife|husband|partner",
    "goal.current": r"目标|挑战|马拉松|\bgoal\b",
    "profile.device": r"电脑是|笔记本|thinkpad|\bdevice\b|\blaptop\b",
}
#: A concept that is asked for along with others counts less.
GENERAL, GENERAL_WEIGHT = "preference.any", 0.2

# Cues of what a question needs.
PERSONAL = r"(?:我的|关于我|对我|我曾|我以前|我过去|我现在|我目前|你记得我|称呼我|本人|\bmy\b|\bme\b|about\s+me|remember\s+me|know\s+about\s+me)"
TIMELINE = r"(?:变化|变迁|历程|时间线|先后|这些年|过去几年|从.+到|历史记录|timeline|over\s+time|through\s+the\s+years|history\s+of)"
SEVERAL = r"(?:以及|还有|分别|各自|同时|和我的|与我的|哪些.{0,12}(?:偏好|习惯|信息)|\b(?:and|also|both|respectively)\b)"
EXTERNAL = r"(?:什么是|定义是什么|如何定义|原理是什么|科普|解释一下|天气|下雨|降雨|气温|气象|空气质量|新闻|汇率|股价|怎么计算|\bwhat\s+is\b|\bdefine\b|\bweather\b|\brain(?:ing)?\b|\btemperature\b|\bnews\b|\bexchange\s+rate\b)"
CORRECTION = r"(?:不是|记错|搞错|写错|更正|纠正|改成|换成|换成了|其实|应该是|以前是|之前是|原来是|不是吧|不对|弄错|更正为|\bnot\b[^.?]*\bmy\b|\bmistake\b|\bactually\b|\bused\s+to\s+be\b|\bchanged\s+to\b|\bcorrect(?:ed|ion)?\b)"
EPISODE = r"(?:上次|上回|刚才|刚刚(?:聊|说|提到)|我们(?:聊过|说过|提到过|讨论过)|聊到过|说过|那次(?:对话|聊天|谈话)|那段对话|前几天(?:聊|说)|\bprevious\s+(?:conversation|chat|talk)\b|\blast\s+(?:conversation|chat|talk)\b|\bwe\s+(?:talked|spoke|discussed)\b|\bthat\s+conversation\b)"
PAST = r"(?:以前|过去|曾经|原来|\bused\s+to\b|\bpreviously\b|\bformerly\b)"
SEPARATOR = r"(?:以及|还有|和|跟|与|分别|各自|同时|;|；|，|,|\band\b|\balso\b)"

#: Fixed values by intent: candidates, rows of the first and of later batches, batches, rows and characters selected at most,
#: and the least score of the best candidate for an answer.
BUDGETS = {
    "enumerative": (80, 8, 8, 8, 10, 4000, 0.20),
    "timeline": (64, 4, 4, 8, 12, 4200, 0.24),
    "temporal": (48, 6, 6, 6, 10, 3200, 0.30),
    "multi-fact": (40, 6, 6, 5, 10, 3200, 0.34),
    "specific": (24, 4, 4, 3, 8, 2400, 0.42),
    "external": (0, 1, 1, 1, 1, 256, 1.0),
}


def concepts(text: Column) -> Column:
    """The concepts that a text is about, in order."""
    low = F.lower(F.coalesce(text, F.lit("")))
    # joined and split, as what a higher-order function reads is interpreted, with the lower case made again for each pattern
    met = F.concat_ws(",", *(F.when(low.rlike(p), F.lit(n)) for n, p in CONCEPTS.items()))
    return F.array_remove(F.split(met, ","), "")
