"""Column types that the operators share. Offsets count code points; starts are inclusive, ends exclusive."""

from __future__ import annotations

SPAN = "struct<start:int,end:int,text:string,labels:array<string>>"
SPANS = f"array<{SPAN}>"
MAPPED = "struct<start:int,end:int,text:string,labels:array<string>,status:string,similarity:double,detected:string,approx_start:int>"
TOKEN = "struct<text:string,start:int,end:int,idx:int>"
TOKENS = f"array<{TOKEN}>"
CANDIDATES = "array<array<struct<tgt:int,score:double>>>"
PATH = "struct<score:double,path:array<struct<src:int,rank:int,tgt:int>>>"
PAIRS = "array<struct<src:int,tgt:int>>"
MATRIX = "array<array<double>>"
ANNOTATION = "struct<type:string,from_name:string,value:struct<start:int,end:int,text:string,labels:array<string>,choices:array<string>>>"
TASK = f"struct<data:struct<text:string>,annotations:array<struct<result:array<{ANNOTATION}>>>,predictions:array<struct<result:array<{ANNOTATION}>>>>"
