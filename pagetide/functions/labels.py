"""Display labels (F39) and status labels of the monitoring reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- Fixed values
FIELD_LABELS = {
    "title": "标题", "name": "名称", "content": "正文内容", "summary": "总结说明",
    "description": "描述", "sections": "章节", "related_terms": "相关词", "company": "公司",
    "salary_range": "薪资范围", "location": "地点", "requirements": "任职要求",
    "job_type": "工作类型", "experience_required": "经验要求", "education_required": "学历要求",
    "benefits": "福利待遇", "skills": "技能标签", "posted_date": "发布日期",
    "publish_date": "发布日期", "author": "作者", "data_stats": "数据统计", "price": "价格",
    "brand": "品牌", "specifications": "规格参数", "category": "分类", "tags": "标签",
    "url": "链接", "id": "编号", "featured_section": "主推荐区", "category_groups": "分类分组",
    "platform_features": "平台特色",
}
PAGE_TYPE_LABELS = {
    "job": "招聘页", "news": "新闻页", "product": "商品页", "article": "文章页", "blog": "博客页",
    "video": "视频页", "forum": "论坛页", "profile": "资料页", "listing": "列表页", "unknown": "未知",
}
ALERT_LABELS = {"changed": "检测到变化", "stable": "页面稳定", "error": "执行失败"}
NOTIFICATION_LABELS = {
    "sent": "已发送", "retry_pending": "等待重试", "retrying": "重试中", "retried": "已转入重试",
    "failed": "发送失败", "skipped": "已跳过",
}
# ---- end of fixed values


def lookup(table: dict[str, str], key: Column) -> Column:
    """Value of a fixed dictionary, NULL for an unknown key."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def field_label(name: Column, own_labels: Column | None = None) -> Column:
    """Own label, else the fixed one, else the name with spaces for underscores."""
    trimmed = F.trim(F.coalesce(name, F.lit("")))
    options = [lookup(FIELD_LABELS, trimmed), F.replace(trimmed, F.lit("_"), F.lit(" "))]
    if own_labels is not None:
        own = F.trim(F.element_at(own_labels, trimmed))
        options.insert(0, F.when(own != "", own))
    return F.coalesce(*options)


def page_type_label(page_type: Column) -> Column:
    name = F.lower(F.trim(F.coalesce(page_type, F.lit(""))))
    name = F.when(name == "", "unknown").otherwise(name)
    return F.coalesce(lookup(PAGE_TYPE_LABELS, name), name)


def alert_label(level: Column) -> Column:
    return F.coalesce(lookup(ALERT_LABELS, F.lower(F.trim(level))), F.lit("等待检查"))


def notification_label(status: Column) -> Column:
    return F.coalesce(lookup(NOTIFICATION_LABELS, F.lower(F.trim(status))), F.lit("未发送"))
