"""Row types of the values nested in the tables."""

from __future__ import annotations

BLOCK = "struct<kind:string,text:string,marker:string,trailing:string,align:string,indent:int,spaceBefore:string,size:string>"
BLOCKS = f"array<{BLOCK}>"
PAGE_REFERENCE = "struct<label:string,value:bigint,numbering:string>"
TOC_ENTRY = "struct<sourcePage:bigint,ordinal:int,title:string,label:string,value:bigint,numbering:string,level:int>"
ANCHOR = "struct<pdfPage:bigint,label:string,value:bigint,numbering:string>"
OBSERVATION = f"struct<pdfPage:bigint,isTableOfContents:boolean,tocEntries:array<{TOC_ENTRY}>,anchor:{ANCHOR}>"

# The allowed words of each enumeration.
KINDS = ("heading", "paragraph", "list_item", "caption", "spacer", "page_number")
ALIGNMENTS = ("left", "center", "right", "justify")
SPACES = ("none", "xs", "sm", "md", "lg", "xl")
SIZES = ("xs", "sm", "md", "lg", "xl")
NUMBERINGS = ("arabic", "roman", "other")
