"""loanrisk: loan-default risk analytics on Spark (DataFrame / SQL / ML)."""
